"""File sources (S1-S4, S7-S9). All reads use explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A parquet table ``{base}/{name}.parquet`` (filters and projections reach the scan)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_posts_csv(spark: SparkSession, path: str, multi_line: bool = False, with_rejects: bool = False) -> DataFrame:
    """Post CSV export; its header row is discarded and the four columns
    are named by position (code, dtime, title, author).

    Files are split among tasks; ``multi_line`` reads quoted line breaks, one
    task a file. Times may lack seconds. ``with_rejects`` adds ``time_text``,
    so rows whose time cannot be read (``dtime`` NULL) can be told.
    """
    raw = (spark.read.schema("code string, time_text string, title string, author string")
           .option("header", True).option("enforceSchema", True)
           .option("multiLine", multi_line).option("escape", '"').csv(path))
    t = F.trim("time_text")
    when = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")))
    out = raw.select("code", when.cast("timestamp_ntz").alias("dtime"), "title", "author", "time_text")
    return out if with_rejects else out.drop("time_text")


def read_sector_list(spark: SparkSession, path: str) -> DataFrame:
    """Header-less tab-separated sector list (bk_code, bk_name)."""
    return spark.read.schema(schemas.SECTOR_LIST_FILE).option("sep", "\t").csv(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """S3: header-less one-column trading calendar (``yyyy-MM-dd`` text) as dates."""
    raw = spark.read.schema(schemas.CALENDAR_FILE).csv(path)
    return raw.select(F.to_date(F.trim("trade_date")).alias("trade_date")).where(F.col("trade_date").isNotNull())


def read_viewpoints(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Opinion sheet landed as CSV/Parquet; columns renamed to (dt, viewpoint)."""
    if fmt == "csv":
        df = spark.read.schema(schemas.VIEWPOINTS).option("header", True).option("multiLine", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.toDF("dt", "viewpoint")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Term list, one per line, all white space trimmed; blank lines dropped (a blank term
    would match every title)."""
    return (spark.read.text(path)
            .select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("term"))
            .where(F.length("term") > 0))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors keyed by word."""
    return spark.read.schema(schemas.WORD_VECTORS).parquet(path)
