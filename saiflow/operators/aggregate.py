"""Counts, histograms, daily series and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import to_yyyymmdd


def posts_per_author(posts: DataFrame, ordered: bool = True) -> DataFrame:
    """A1/O1: posts per author, most active first (ties by author).

    A two-phase hash aggregate: a hot author is combined map-side, so one
    author holding a third of the rows does not load one reducer. The global
    sort (a range-partitioned shuffle) is only for a final report; pass
    ``ordered=False`` when the counts feed another step.
    """
    counts = posts.groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.orderBy(F.desc("n_posts"), "author") if ordered else counts


def author_histogram(counts: DataFrame, value_col: str = "n_posts", bins: int = 20) -> DataFrame:
    """A3: equal-width histogram of per-author counts, ``bins`` bins between the
    minimum and maximum, last bin closed, empty bins reported as 0.

    When all values are equal the range is widened by 0.5 on each side (as the
    plotting library does). Bin assignment uses integer arithmetic so edges
    are exact. The minimum and maximum are one scalar subquery, bound to a
    column once; the bin grid is generated from the per-bin result, whose
    shuffle is reused.
    """
    v = F.col(value_col)
    stats = counts.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("s")).scalar()
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    equal = lo == hi
    # numerator/denominator of the bin position, doubled so that the +-0.5
    # widening stays integral: (2v - 2lo + 1) / 2 over a width of 1.
    num = F.when(equal, (v - lo) * 2 * bins + bins).otherwise((v - lo) * bins)
    den = F.when(equal, F.lit(2)).otherwise(hi - lo)
    per_bin = (counts.withColumn("_s", stats)
               .groupBy(F.least((num / den).cast("long").cast("int"), F.lit(bins - 1)).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n_authors"), F.first("_s").alias("_s")))
    grid = per_bin.agg(F.first("_s").alias("_s")).select(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo_d = F.when(equal, lo - 0.5).otherwise(lo.cast("double"))
    width = F.when(equal, F.lit(1.0)).otherwise((hi - lo).cast("double"))
    return (grid.join(per_bin.drop("_s"), "bin", "left")
            .select("bin",
                    (lo_d + F.col("bin") * width / bins).alias("left_edge"),
                    (lo_d + (F.col("bin") + 1) * width / bins).alias("right_edge"),
                    F.coalesce("n_authors", F.lit(0)).cast("long").alias("n_authors")))


def daily_post_volume(posts: DataFrame) -> DataFrame:
    """A2/O2: posts per code and day."""
    return (posts.groupBy("code", F.to_date("dtime").alias("trade_date"))
            .agg(F.count(F.lit(1)).alias("n_posts"))
            .orderBy("code", "trade_date"))


def on_trade_days(daily: DataFrame, calendar: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Keep days listed in the trading calendar (left semi join; the
    calendar holds one row per day, so AQE broadcasts it)."""
    return daily.join(calendar.select(F.col("trade_date").alias(date_col)), date_col, "left_semi")


def format_trade_date(df: DataFrame, date_col: str = "trade_date", out_col: str = "trade_date") -> DataFrame:
    """``yyyy-MM-dd`` -> ``yyyyMMdd`` text."""
    return df.withColumn(out_col, to_yyyymmdd(date_col))


def viewpoints_by_day(views: DataFrame, start: str, dt_col: str = "dt", text_col: str = "viewpoint",
                      ord_col: str = "ord", salts: int = 64) -> DataFrame:
    """The opinions of each day since ``start``, one row each: (dt,
    pos, viewpoint) with ``pos`` from 0 in ``ord`` order, NULL opinions included.

    A day can hold any number of opinions, so it is numbered in parts: ``ord``
    is cut into ``salts`` equal ranges, rows are numbered within (day, range),
    and the rows of lower ranges are added. No group is a list or one task's work.
    """
    d, o = F.col(dt_col), F.col(ord_col)
    v = views.where(d.isNotNull() & (d >= F.lit(start)))
    span = v.agg(F.struct(F.min(o).alias("lo"), F.max(o).alias("hi")).alias("s")).scalar()
    width = F.greatest(F.ceil((F.col("_s.hi") - F.col("_s.lo") + 1) / salts), F.lit(1))
    cut = v.withColumn("_s", span).withColumn("_part", F.floor((o - F.col("_s.lo")) / width)).drop("_s")
    before = cut.groupBy(dt_col, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(dt_col, "_part", (F.sum("_n").over(Window.partitionBy(dt_col).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(dt_col, "_part").orderBy(ord_col)) - 1
    return cut.withColumn("_own", own).join(before, [dt_col, "_part"]).select(
        dt_col, (F.col("_own") + F.col("_before")).alias("pos"), F.col(text_col).alias("viewpoint"))
