"""Reads by SQL (S5, S6): bound parameters on catalog tables, or JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def param_sql(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """Run ``sql`` with named parameter markers (``:name``) bound from ``args``.

    ``views`` are DataFrames that the statement names in braces (``{name}``);
    the session's own views stay as they are. Values are bound, never spliced
    into the text.
    """
    return spark.sql(sql, args=args or {}, **views)


def jdbc_read(spark: SparkSession, url: str, table: str, *, user: str | None = None,
              password: str | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, fetch_size: int = 10_000, single_task: bool = False) -> DataFrame:
    """S5 over JDBC. ``table`` is a table name or a parenthesised subquery with
    an alias. The read is split into ``num_partitions`` range queries on
    ``partition_column`` between the bounds; a read by one task must be asked
    for with ``single_task``.
    """
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("fetchsize", fetch_size))
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if not single_task:
        if None in (partition_column, lower, upper, num_partitions):
            raise ValueError("name partition_column, lower, upper and num_partitions, or ask for single_task")
        r = (r.option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper)
             .option("numPartitions", num_partitions))
    return r.load()
