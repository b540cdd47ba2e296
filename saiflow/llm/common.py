"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder of the shared scratch area and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so a
    lost executor costs only its own tasks.
    """
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage_alone(spark: SparkSession, df: DataFrame, name: str, values: dict[str, str] | None = None) -> DataFrame:
    """``stage``, after which the shuffle files of its plan are removed at once, not when the driver happens to collect
    garbage; ``values`` are settings for this plan."""
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (values or {})):
        return stage(spark, df, name)


def spread(spark: SparkSession) -> int:
    """Partitions for a step whose small input stands for much work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def byte_slices(column: pa.Array, limit: int = 1 << 20):
    """Cut a string or binary column into runs of rows of about ``limit`` bytes.

    Yields (first row, last row, bytes as uint8, offsets from 0). A single
    longer row makes a run of its own. Nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def perhaps(rows: DataFrame, ids: DataFrame, key: str = "node", bits: int = 22) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``, to be joined then with a smaller
    shuffle: a bitmap of 2^bits hash classes of keys, whose size does not depend on the data, goes to all tasks."""
    number = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    classes = ids.select(number.alias("c"))
    longs = classes.groupBy(F.shiftright("c", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 AS int))")).alias("w")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[longs.column("at").to_numpy()] = longs.column("w").to_numpy()

    @F.pandas_udf("boolean")
    def maybe(c: pd.Series) -> pd.Series:
        c = c.to_numpy()
        return pd.Series((bitmap[c >> 6] >> (c & 63)) & 1 == 1)

    return rows.filter(maybe(number))


def native_perhaps(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 24) -> DataFrame:
    """As ``perhaps``, in built-in functions alone: the bitmap is one array, read as a scalar subquery."""
    number = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))
    words = wanted.select(number.alias("c")).groupBy(F.shiftright("c", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(c & 63 AS int))")).alias("w"))
    # every word of the map has a row, so the sorted list is the map itself: 2^(bits - 6) numbers at any size of input
    every = rows.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("w"))
    full = words.unionByName(every).groupBy("at").agg(F.bit_or("w").alias("w"))
    bitmap = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).scalar()
    word = F.element_at(bitmap, F.shiftright(number, 6).cast("int") + 1)
    return rows.filter(F.getbit(word, number.bitwiseAND(F.lit(63)).cast("int")) == 1)
