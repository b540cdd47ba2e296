"""Catalog tables, bucketed by key.

A bucketed table keeps the rows of a key in one file of a known number, so a
load that asks which keys are stored reads the table as it lies: only the new
rows are shuffled, however large the table has grown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def create_bucketed(rows: DataFrame, table: str, keys: list[str] | None = None, buckets: int = 8, path: str | None = None) -> None:
    """K1: a new catalog table of ``rows``, bucketed and sorted by ``keys``; at ``path`` if that is given."""
    keys = keys or schemas.POST_KEYS
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def absent_from_table(spark: SparkSession, new: DataFrame, table: str, keys: list[str] | None = None) -> DataFrame:
    """The distinct rows of ``new``, by key, whose key is not in the bucketed ``table``; rows with a null key are left out.

    The hint keeps the join on the table's buckets: broadcast, the stored side
    would be read by every task.
    """
    keys = keys or schemas.POST_KEYS
    fresh = new.dropna(subset=keys).dropDuplicates(keys)
    stored = spark.table(table).select(*keys)
    return fresh.join(stored.hint("merge"), keys, "left_anti")


def append_absent(spark: SparkSession, new: DataFrame, table: str, keys: list[str] | None = None, buckets: int = 8) -> None:
    """L1/K1: append to the bucketed ``table`` what it does not hold yet; columns go by name. Run again, it appends nothing."""
    keys = keys or schemas.POST_KEYS
    columns = spark.table(table).columns
    missing = set(columns) ^ set(new.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are not in both {table} and the new rows")
    rows = absent_from_table(spark, new, table, keys).select(*columns)
    rows.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
