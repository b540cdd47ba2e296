"""Sector lists and bar tables: distinct codes and the coverage check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sectors(sector_info: DataFrame, bk_source: str, bk_type: str) -> DataFrame:
    """Distinct sector codes of one source and type, ordered."""
    return (sector_info.where((F.col("bk_source") == bk_source) & (F.col("bk_type") == bk_type))
            .select("bk_code").distinct().orderBy("bk_code"))


def coverage_check(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Bars per sector and year, against the calendar's trading days.

    ``bars.trade_date`` is ``yyyyMMdd`` text; the year is its 4-character
    prefix (``like 'yyyy%'``). ``expected`` is the number of calendar days
    in that year (NULL without a calendar); ``complete`` flags equality.
    """
    per = bars.groupBy(F.substring("trade_date", 1, 4).alias("year"), "bk_code") \
              .agg(F.count(F.lit(1)).alias("n_bars"))
    if calendar is None:
        return per.withColumn("expected", F.lit(None).cast("long")).withColumn("complete", F.lit(None).cast("boolean"))
    exp = calendar.groupBy(F.date_format("trade_date", "yyyy").alias("year")) \
                  .agg(F.count(F.lit(1)).alias("expected"))
    # one row per calendar year: broadcast
    return per.join(F.broadcast(exp), "year", "left").withColumn("complete", F.col("n_bars") == F.col("expected"))
