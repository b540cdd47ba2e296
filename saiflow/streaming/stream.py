"""Continuous forms of the post load (T1) and of the daily volume.

The original is a batch poller; here landed post files are a streaming file
source. Each micro-batch is loaded by the same anti join as a batch load, so a
post takes effect once however late it lands and however often it is crawled
or a batch is replayed; no post is dropped by a watermark and no state is kept
but the stored table. Daily counts are then taken anew from the stored posts
for the days that the micro-batch touched.

The event-time forms at the end keep state instead and read no stored table
for what is in time: duplicates are dropped within a watermark, late posts go
to an exact load, and days are counted in windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.aggregate import daily_post_volume
from ..operators.clean import clean_posts
from ..operators.load import append_posts, insert_if_absent, stored_days, write_rejects
from ..operators.parse import parse_forum_page
from ..session import ensure_checkpoint_dir, path_exists, scratch_path, staged
from ..sources.sinks import overwrite_partitions


def read_landed_posts(spark: SparkSession, landing: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder where crawled post batches land."""
    r = spark.readStream.schema(schemas.POSTS).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(landing)


def read_landed_pages(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over landed listing pages (``raw_pages`` schema)."""
    r = spark.readStream.schema(schemas.RAW_PAGES).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(landing)


def posts_from_pages(pages: DataFrame) -> DataFrame:
    """Landed pages -> posts (P1; year from each page's fetch time), with the
    text of the time. A pure DataFrame transform, so it runs the same on a stream or a batch."""
    return parse_forum_page(pages, "fetch", keep=["code"]).select(*schemas.POST_KEYS, "time_text")


def _start(posts: DataFrame, step, name: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    spark = posts.sparkSession
    ensure_checkpoint_dir(spark)
    w = posts.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _load(batch: DataFrame, batch_id: int, target: str, rejects: str | None) -> DataFrame:
    """Clean a micro-batch and append what is not stored yet; returns the appended posts."""
    rows = batch.checkpoint(eager=True)
    if rejects is not None:
        bad = rows.where(F.greatest(*(F.col(c).isNull() for c in schemas.POST_KEYS)))
        write_rejects(bad, rejects, f"stream-{batch_id}")
    return append_posts(batch.sparkSession, clean_posts(rows).select(*schemas.POST_KEYS), target)


def start_dedup_load(spark: SparkSession, landing: str, target: str, name: str = "posts_load",
                     available_now: bool = True, pages: bool = False, rejects: str | None = None) -> StreamingQuery:
    """Land -> clean -> insert-if-absent into the parquet table.

    Each micro-batch is deduplicated (combined before its shuffle) and
    anti-joined with the stored keys of its days, so a replayed batch (after a
    failure between write and commit) and a re-crawled post append nothing
    twice, and a late post is stored like any other. ``pages=True``: the
    landing folder holds raw listing pages, which are parsed in the stream
    first. Posts that cannot be loaded go to the table at ``rejects``.
    """
    src = posts_from_pages(read_landed_pages(spark, landing)) if pages else read_landed_posts(spark, landing)
    return _start(src, lambda batch, i: _load(batch, i, target, rejects), name, available_now)


def start_daily_volume(spark: SparkSession, landing: str, target: str, sink: str, name: str = "daily_volume",
                       available_now: bool = True) -> StreamingQuery:
    """Loads posts as T1 does and keeps the table ``sink`` of posts per code
    and day (one folder a day), whose touched days are counted anew from the
    stored posts: an update of exact counts, without an end of lateness."""

    def count(batch: DataFrame, batch_id: int) -> None:
        ss = batch.sparkSession
        _load(batch, batch_id, target, None)
        # a replay appends nothing, so the days come from the batch itself
        days = batch.select(F.to_date("dtime").alias("day")).where("day is not null").distinct().checkpoint(eager=True)
        if days.isEmpty():
            return
        stored = ss.read.parquet(target).join(F.broadcast(days), "day", "left_semi")
        daily = daily_post_volume(stored.select(*schemas.POST_KEYS))
        overwrite_partitions(daily.withColumn("day", F.col("trade_date")), sink, ["day"])

    return _start(read_landed_posts(spark, landing), count, name, available_now)


# ---- event-time forms ----------------------------------------------------------------

def _append_load(rows: DataFrame, target: str, load: str) -> None:
    """Rows of one load, in folders of their own (day, load): a load that runs again replaces what it wrote."""
    overwrite_partitions(rows.withColumns({"day": F.to_date("dtime"), "load": F.lit(load)}), target, ["day", "load"])


def start_watermark_dedup(spark: SparkSession, landing: str, target: str, delay: str = "2 days", name: str = "posts_watermark",
                          available_now: bool = True) -> StreamingQuery:
    """T1 in event time: land -> clean -> one row for each post key, by Spark's state alone.

    State holds the keys of the last ``delay`` of event time, so the stored
    table is never read. Posts that are later than that are not in this
    stream's result; ``start_late_load`` stores them.
    """
    posts = clean_posts(read_landed_posts(spark, landing)).where(F.least(*(F.col(c).isNotNull() for c in schemas.POST_KEYS)))
    once = posts.withColumn("_event", F.col("dtime").cast("timestamp")).withWatermark("_event", delay).dropDuplicatesWithinWatermark(schemas.POST_KEYS)
    return _start(once.drop("_event"), lambda batch, i: _append_load(batch, target, f"{name}-{i}"), name, available_now)


def start_late_load(spark: SparkSession, landing: str, target: str, seen: str, delay: str = "2 days", name: str = "posts_late",
                    available_now: bool = True) -> StreamingQuery:
    """The exact load of late posts, after ``start_watermark_dedup`` took the same files with the same ``delay``.

    A post is late if one that landed before or with it is newer by more than
    ``delay``; that holds for every post the state had given up. Late posts
    are inserted if absent among the stored ones of their days. ``seen`` is a
    table of the newest time of each micro-batch, one row a batch.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        ss = batch.sparkSession
        rows = clean_posts(batch).select(*schemas.POST_KEYS)
        newest = rows.agg(F.max("dtime").alias("newest"))
        newest.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{seen}/load={name}-{batch_id}")
        # batches up to this one: a repeated batch sees what it saw before
        top = ss.read.parquet(seen).where((F.col("load").startswith(f"{name}-")) & (F.col("batch") <= batch_id)).agg(F.max("newest")).scalar()
        late = staged(rows.where(F.col("dtime") < top - F.expr(f"interval {delay}")).withColumn("day", F.to_date("dtime")), "late-posts")
        if late.isEmpty():
            return
        own = f"{name}-{batch_id}"
        if path_exists(ss, target):
            stored = stored_days(ss.read.parquet(target), late).where(F.col("load") != own).select("day", *schemas.POST_KEYS)
        else:
            stored = late.limit(0)
        fresh = staged(insert_if_absent(late, stored, ["day", *schemas.POST_KEYS]), "late-fresh")
        _append_load(fresh.drop("day"), target, own)

    return _start(read_landed_posts(spark, landing), load, name, available_now)


def start_windowed_volume(spark: SparkSession, landing: str, sink: str, delay: str = "2 days", name: str = "windowed_volume",
                          available_now: bool = True) -> StreamingQuery:
    """T2 in event time: landed posts counted by code and day in state, in update mode.

    Each micro-batch hands on the counts that it changed, to a folder of its
    own. A day leaves the state when the newest post is ``delay`` past its
    end; posts for it that land later are not counted here (``start_daily_volume`` counts without an end of lateness).
    """
    posts = read_landed_posts(spark, landing).withColumn("_event", F.col("dtime").cast("timestamp")).withWatermark("_event", delay)
    counts = posts.groupBy("code", F.window("_event", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_posts"))
    rows = counts.select("code", F.to_date("w.start").alias("trade_date"), "n_posts")

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(rows, hand_on, name, available_now, "update")


def windowed_volume(spark: SparkSession, sink: str) -> DataFrame:
    """code, trade_date, n_posts as ``start_windowed_volume`` last handed them on (a count only grows)."""
    return spark.read.parquet(sink).groupBy("code", "trade_date").agg(F.max("n_posts").alias("n_posts"))
