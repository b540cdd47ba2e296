"""Connected components of a table of links, in rounds of two star steps.

Large star: every node links its greater neighbours to its least neighbour.
Small star: every node links its lesser neighbours, and itself, to the least.
Rounds go on until the links are unchanged; then each node is linked to its
component's least node. A round is aggregates (combined before their shuffle)
and joins that adaptive execution can split, so a node with very many links is
no single task's work, and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns u, v: longs); component is its least node.

    Null ends and links of a node to itself are dropped; an empty table gives no rows.
    """
    links = stage(spark, links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).alias("m")
    before = None
    while True:
        links = stage(spark, _small_star(_large_star(links)), "links")
        now = links.agg(mark).first().m
        if now == before or now.n == 0:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
