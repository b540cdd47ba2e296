"""Sinks (K1, K2) and partition overwrite used by upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import path_exists


def append_by_name(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K1: append rows; columns are matched by name. A stored table must have
    the same columns and types; appending others is an error."""
    spark = df.sparkSession
    if path_exists(spark, path):
        stored = {f.name: f.dataType for f in spark.read.parquet(path).schema}
        own = {f.name: f.dataType for f in df.schema}
        if stored and stored != own:
            raise ValueError(f"{path} has {stored}, not {own}")
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite); without rows nothing is written."""
    if df.isEmpty():
        return
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by)
       .parquet(path))


def write_tsv(df: DataFrame, path: str) -> None:
    """K2: tab-separated text with a header row; one part file per partition.
    A quote inside a field is doubled; a field with a line break is quoted and
    needs a reader that allows it."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(path)
