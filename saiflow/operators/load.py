"""Dedup and idempotent loads.

Plain parquet tables have no MERGE, so loads are expressed as joins:
insert-if-absent is an anti join against the stored keys; an upsert keeps
stored rows whose key is not in the new batch and adds the new batch, and is
written by dynamic partition overwrite through a staged copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import drop_scratch, ensure_checkpoint_dir, path_exists, scratch_path, staged
from ..sources.sinks import append_by_name, overwrite_partitions
from .clean import session_hours


def _non_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns are NOT NULL in the stored tables; rows with a null key are
    not loadable and are left out (a database would reject them too)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def with_code(posts: DataFrame, code: str) -> DataFrame:
    """Set the constant board/stock code of a crawled batch."""
    return posts.withColumn("code", F.lit(code))


def with_collation(df: DataFrame, keys: list[str], collation: str | None) -> DataFrame:
    """Give the string key columns a collation (e.g. ``UTF8_LCASE`` or
    ``UNICODE_CI_AI``) so grouping and joins compare them like a
    case-insensitive database key would. ``None`` keeps binary comparison."""
    if not collation:
        return df
    strings = {c for c, t in df.dtypes if t == "string" or t.startswith("string collate")}
    return df.select(*[F.collate(F.col(c), collation).alias(c) if c in keys and c in strings else F.col(c)
                       for c in df.columns])


def _plain_strings(df: DataFrame) -> DataFrame:
    """Collated string columns back to plain (binary) strings for writing."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("string collate") else F.col(c)
                       for c, t in df.dtypes])


def dedup_posts(posts: DataFrame, keys: list[str] | None = None, order_col: str | None = None,
                collation: str | None = None) -> DataFrame:
    """One row per key. With ``order_col`` the first row (smallest order)
    is kept deterministically; otherwise any (all columns are keys for posts).
    ``collation`` compares string keys under that collation (binary by default)."""
    keys = keys or schemas.POST_KEYS
    posts = with_collation(posts, keys, collation)
    if order_col is None:
        return posts.dropDuplicates(keys)
    others = [c for c in posts.columns if c not in keys]
    first = posts.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return first.select(*keys, "_r.*").select(*posts.columns)


def union_batches(*batches: DataFrame) -> DataFrame:
    """Concatenate crawled batches by column name."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def insert_if_absent(new: DataFrame, target: DataFrame, keys: list[str] | None = None,
                     order_col: str | None = None, collation: str | None = None) -> DataFrame:
    """Rows of ``new`` (deduplicated) whose key is not stored yet.

    Appending the result is idempotent: a rerun finds every key stored. With
    ``collation`` (e.g. ``UTF8_LCASE``) keys that differ only in case count as
    the same key, as in a case-insensitive database table.
    """
    keys = keys or schemas.POST_KEYS
    fresh = dedup_posts(_non_null_keys(new, keys), keys, order_col, collation)
    # a plain equi-join on the keys reuses the dedup's hash partitioning, so
    # the batch side is shuffled once
    rows = fresh.join(with_collation(target.select(*keys), keys, collation), keys, "left_anti")
    return _plain_strings(rows) if collation else rows


def append_until_conflict(new: DataFrame, target: DataFrame, order_col: str,
                          keys: list[str] | None = None) -> DataFrame:
    """The literal non-transactional insert — rows are written in batch
    order and the insert stops at the first row whose key is already stored;
    rows before it stay.

    First-conflict position is one scalar aggregate; no global window.
    """
    keys = keys or schemas.POST_KEYS
    fresh = dedup_posts(_non_null_keys(new, keys), keys, order_col)
    first_conflict = (fresh.join(target.select(*keys), keys, "left_semi")
                      .agg(F.min(order_col).alias("_fc")))
    bound = first_conflict.scalar()
    return fresh.where(F.coalesce(F.col(order_col) < bound, F.lit(True)))


def incremental_backfill(new: DataFrame, stored: DataFrame, year: int,
                         keys: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """The batch form of the nightly backfill.

    Posts of ``year`` strictly inside the trading session that are not stored
    yet, whatever their day: a post that arrives late, or on a day that is
    partly stored, is taken too. The anti join reads the stored rows of the
    batch's time range only (a runtime filter), and is idempotent.
    """
    keys = keys or schemas.POST_KEYS
    cand = new.where((F.year("dtime") == F.lit(year)) & session_hours("dtime"))
    span = cand.agg(F.struct(F.min("dtime").alias("lo"), F.max("dtime").alias("hi")).alias("r")).scalar()
    near = stored.withColumn("_r", span).where(F.col("dtime").between(F.col("_r.lo"), F.col("_r.hi"))).drop("_r")
    return insert_if_absent(cand, near, keys, order_col)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """L2: the table after loading ``new`` — stored rows whose key is not in
    the batch, plus the batch (the batch wins on conflicts).

    Within the batch the row with the greatest ``order_col`` wins, and among
    equal ones the greatest row. Rows with a null key are not loadable and are
    left out; the batch is cast to the stored columns (see ``align``).
    """
    batch = _non_null_keys(new, keys)
    rest = [c for c in new.columns if c not in keys and c != order_col]
    one = batch.groupBy(*keys).agg(F.max(F.struct(F.col(order_col).alias("_o"), *rest)).alias("_r"))
    one = one.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest),
                     *([F.col("_r._o").alias(order_col)] if order_col in stored.columns and order_col not in keys else []))
    kept = stored.join(one.select(*keys), keys, "left_anti")
    return kept.unionByName(align(one, stored))


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns, order and types of ``like``: columns that it
    lacks are NULL; a column that ``like`` lacks is an error, not a loss."""
    extra = [c for c in df.columns if c not in like.columns]
    if extra:
        raise ValueError(f"columns {extra} are not in the stored table")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


# ---- writers -----------------------------------------------------------------

def stored_days(stored: DataFrame, batch: DataFrame, partition_col: str = "day") -> DataFrame:
    """The stored rows of the days present in ``batch``.

    The batch's first and last day (one scalar subquery) become a runtime
    partition filter on the stored table, so the scan lists and reads only
    the partitions in that range, not the whole history; a semi join then
    keeps exactly the batch's days.
    """
    rng = batch.agg(F.struct(F.min(partition_col).alias("lo"), F.max(partition_col).alias("hi")).alias("r")).scalar()
    p = F.col(partition_col)
    in_range = stored.withColumn("_r", rng).where(p.between(F.col("_r.lo"), F.col("_r.hi"))).drop("_r")
    # one row per day of the batch: broadcast, so a heavy day of the stored
    # table is never funnelled into one shuffle partition
    return in_range.join(F.broadcast(batch.select(partition_col).distinct()), partition_col, "left_semi")


def _append_absent(spark: SparkSession, new: DataFrame, path: str, order_col: str | None, partition_col: str) -> tuple[DataFrame, int]:
    """Append the not-yet-stored posts of ``new`` to the parquet table at ``path``; returns them and their number.

    The table is partitioned by post day (``partition_col``), which is one of
    the anti-join keys, so only the batch's days of the stored table are read.
    The batch is written to the shared folder once, since its days are looked
    at before it is joined, and so is the delta, which is read back to be appended.
    """
    keys = [partition_col] + schemas.POST_KEYS
    batch = staged(new.withColumn(partition_col, F.to_date("dtime")), "load-batch")
    if path_exists(spark, path):
        target = stored_days(spark.read.parquet(path).select(*keys), batch, partition_col)
    else:
        target = spark.createDataFrame([], batch.select(*keys).schema)
    rows = insert_if_absent(batch, target, keys=keys, order_col=order_col)
    if order_col is not None:
        rows = rows.drop(order_col)
    written = Observation()
    rows = staged(rows.observe(written, F.count(F.lit(1)).alias("n")), "load-delta")
    if written.get["n"]:  # a table without any file could not be read back
        append_by_name(rows, path, partition_by=[partition_col])
    return rows, written.get["n"]


def append_posts(spark: SparkSession, new: DataFrame, path: str, order_col: str | None = None, partition_col: str = "day") -> DataFrame:
    """Append the not-yet-stored posts of ``new`` to the parquet table at ``path``, and return them."""
    return _append_absent(spark, new, path, order_col, partition_col)[0]


def load_posts(spark: SparkSession, new: DataFrame, path: str, order_col: str | None = None,
               partition_col: str = "day") -> int:
    """``append_posts``; returns the number of rows appended (A9), counted while they are written."""
    return _append_absent(spark, new, path, order_col, partition_col)[1]


def upsert_bars_to_path(spark: SparkSession, new: DataFrame, path: str, run_id: str, order_col: str) -> None:
    """L2 writer: bars partitioned by ``year``; only the years present in the
    batch are rewritten. The merged years are staged under the shared
    checkpoint folder first, since Spark cannot overwrite a path it is
    reading; the staged copy is removed afterwards.

    A table that is there but cannot be read, or has other columns, is an
    error: nothing is written then. Rows whose date has no year are left out,
    like rows with a null key.
    """
    # int, as partition discovery reads it back
    batch = new.withColumn("year", F.substring("trade_date", 1, 4).try_cast("int")).where(F.col("year").isNotNull())
    if path_exists(spark, path):
        stored = spark.read.parquet(path).join(F.broadcast(batch.select("year").distinct()), "year", "left_semi")
    else:
        stored = spark.createDataFrame([], batch.drop(order_col).schema)
    stage = scratch_path(spark, f"stage-bars-{run_id}")
    upsert(stored, batch, ["year", "bk_code", "trade_date"], order_col).write.mode("overwrite").partitionBy("year").parquet(stage)
    overwrite_partitions(spark.read.parquet(stage), path, ["year"])
    drop_scratch(spark, stage)


def write_rejects(rows: DataFrame, path: str, run_id: str) -> None:
    """Keep what could not be loaded, by run; a repeated run replaces its own."""
    overwrite_partitions(rows.withColumn("run_id", F.lit(run_id)), path, ["run_id"])


def ingest_pages(spark: SparkSession, pages: DataFrame, target: str, year: int | str = "fetch",
                 name_grams: DataFrame | None = None, rejects: str | None = None, run_id: str = "0") -> int:
    """E1 as one batch job: landed listing pages (``raw_pages``: page_no, code,
    html, fetched_at) -> parsed posts -> cleaned (F2-F5, optional F3) ->
    loaded into the day-partitioned post table if absent. Returns the number
    of posts appended. Posts without a readable time, author or code go to the
    table at ``rejects``, if one is named. Every step runs on the executors.
    """
    from .clean import clean_posts
    from .parse import parse_forum_page

    ensure_checkpoint_dir(spark)
    posts = staged(parse_forum_page(pages, year, keep=["code"]), "ingest-posts")
    if rejects is not None:
        bad = posts.where(F.greatest(*(F.col(c).isNull() for c in schemas.POST_KEYS)))
        write_rejects(bad.select("code", "time_text", "title", "author"), rejects, run_id)
    return load_posts(spark, clean_posts(posts.select(*schemas.POST_KEYS), name_grams=name_grams), target)


def load_bars(spark: SparkSession, payloads: DataFrame, path: str, run_id: str, rejects: str | None = None) -> None:
    """E3 as one batch job: landed quote payloads (bk_code, body) for every
    sector and year -> parsed bars (P4) -> upsert into the year-partitioned
    bar table (L2); of repeated days the one later in its payload wins.
    Rows that cannot be read go to the table at ``rejects``, if one is named.
    Replaces the per-sector driver loop of the original."""
    from .parse import parse_bars

    ensure_checkpoint_dir(spark)
    rows = staged(parse_bars(payloads, with_rejects=True), "ingest-bars")
    if rejects is not None:
        write_rejects(rows.where("reason is not null").select("bk_code", "pos", "row", "reason"), rejects, run_id)
    upsert_bars_to_path(spark, rows.where("reason is null").drop("row", "reason"), path, run_id, order_col="pos")
