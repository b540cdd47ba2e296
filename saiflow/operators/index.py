"""Attention series, prices and the sector indices.

The sector attention index (SAI), its abnormal form, the sentiment form and
the regressions are stated, not coded, by the original project; the formulas
below are OUR CHOICES, taken from the published literature, and are labelled
as such:

* SAI (X1): posts per sector and period, over the sector's constituents.
* Abnormal SAI (X3): ln(1 + n_t) - ln(1 + median(n_{t-k} .. n_{t-1}))
  (Da, Engelberg & Gao 2011 form, with 1+ because zero periods occur).
* Sentiment SAI (X4): ln((1 + call) / (1 + put)) (Antweiler & Frank 2004).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import to_yyyymmdd


# ---- attention vs. price (E2) ------------------------------------------------

def attention_vs_close(daily: DataFrame, prices: DataFrame, how: str = "inner") -> DataFrame:
    """Daily post counts against daily closes per code.

    ``daily(code, trade_date, n_posts)``, ``prices(ts_code, trade_date, close)``.
    ``how='inner'`` keeps days with both; ``how='right'`` keeps every price day
    with a zero count where no post exists. ``idx`` is the 0-based day number
    per code (window partitioned by code, never global).
    """
    p = prices.select(F.col("ts_code").alias("code"), "trade_date", "close")
    if how == "inner":
        j = daily.join(p, ["code", "trade_date"], "inner")
    elif how == "right":
        j = daily.join(p, ["code", "trade_date"], "right") \
                 .withColumn("n_posts", F.coalesce("n_posts", F.lit(0)).cast("long"))
    else:
        raise ValueError(f"unsupported join type {how!r}")
    w = Window.partitionBy("code").orderBy("trade_date")
    return j.select("code", to_yyyymmdd("trade_date").alias("trade_date"), "n_posts", "close",
                    (F.row_number().over(w) - 1).cast("long").alias("idx"))


# ---- sector attention (X1-X4) ------------------------------------------------

def _period(col: str, period: str):
    c = F.col(col)
    if period == "day":
        return c.cast("date")
    if period in ("week", "month", "quarter", "year"):
        return F.date_trunc(period, c).cast("date")
    raise ValueError(f"unsupported period {period!r}")


def _step(period: str):
    return {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
            "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}[period]


def sector_attention(posts: DataFrame, constituents: DataFrame, period: str = "day",
                     date_col: str = "trade_date", zero_fill: bool = True, calendar: DataFrame | None = None) -> DataFrame:
    """SAI = posts about a sector's constituent stocks per period.

    Posts are counted by (code, period) before they meet the constituents, so
    a hot stock is one row for each period and not one for each post; a stock in two
    sectors counts for both. Pass the representative stocks
    (``top_stocks_per_sector``) as ``constituents`` for the index as stated.
    With ``zero_fill`` every sector gets every period between the first and
    last one of the posts. By day that needs the trading ``calendar``: days
    off it have no row, and posts on them are left out.
    """
    p = posts.select("code", _period(date_col, period).alias("period")).groupBy("code", "period").agg(F.count(F.lit(1)).alias("n"))
    cons = constituents.select("bk_code", "code").distinct()
    counts = p.join(cons, "code").groupBy("bk_code", "period").agg(F.sum("n").alias("n_posts"))
    if calendar is not None:
        days = calendar.select(F.col("trade_date").cast("date").alias("period")).distinct()
        counts = counts.join(F.broadcast(days), "period", "left_semi")
    if not zero_fill:
        return counts.select("bk_code", "period", "n_posts")
    if period == "day" and calendar is None:
        raise ValueError("a daily index with zeros needs the trading calendar")
    # first/last period: one scalar subquery, bound to a column once so it is
    # evaluated once (each textual use of a scalar would be its own scan)
    rng = p.agg(F.struct(F.min("period").alias("lo"), F.max("period").alias("hi")).alias("s")).scalar()
    sectors = cons.select("bk_code").distinct().withColumn("_r", rng)
    if calendar is None:
        each = F.sequence(F.col("_r.lo"), F.col("_r.hi"), F.expr(_step(period)))
    else:  # a calendar is one row a day: its days are one bounded list
        listed = days.agg(F.array_sort(F.collect_list("period"))).scalar()
        sectors = sectors.withColumn("_d", listed)
        each = F.filter("_d", lambda x: (x >= F.col("_r.lo")) & (x <= F.col("_r.hi")))
    grid = sectors.select("bk_code", F.explode(each).alias("period"))
    return grid.join(counts, ["bk_code", "period"], "left") \
               .select("bk_code", "period", F.coalesce("n_posts", F.lit(0)).cast("long").alias("n_posts"))


def abnormal_attention(sai: DataFrame, k: int = 5, key_col: str = "bk_code") -> DataFrame:
    """ln(1+n) - ln(1 + median of the previous ``k`` periods) per sector.

    The window is partitioned by sector and bounded to ``k`` rows; the first
    period of a sector has no history and gets NULL.
    """
    w = Window.partitionBy(key_col).orderBy("period").rowsBetween(-k, -1)
    med = F.percentile(F.col("n_posts"), F.lit(0.5)).over(w)
    return sai.select(key_col, "period", "n_posts",
                      (F.log1p("n_posts") - F.log1p(med)).alias("abnormal"))


def sentiment_attention(labelled: DataFrame, key_col: str = "code", day_col: str = "day") -> DataFrame:
    """Posts, put and call counts and ln((1+call)/(1+put)) per key and day."""
    agg = labelled.groupBy(key_col, day_col).agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.count_if(F.col("label") == "put").alias("n_put"),
        F.count_if(F.col("label") == "call").alias("n_call"))
    return agg.withColumn("bullish", _bullish())


def _bullish():
    return F.log((F.col("n_call") + 1) / (F.col("n_put") + 1))


def sector_sentiment(labelled: DataFrame, constituents: DataFrame, day_col: str = "day") -> DataFrame:
    """X4 per sector: put and call counts of the sector's stocks by day.
    Posts are counted by stock and day before they meet the constituents."""
    by_code = sentiment_attention(labelled, "code", day_col).drop("bullish")
    j = by_code.join(constituents.select("bk_code", "code").distinct(), "code")
    agg = j.groupBy("bk_code", day_col).agg(*(F.sum(c).alias(c) for c in ("n_posts", "n_put", "n_call")))
    return agg.withColumn("bullish", _bullish())


def top_stocks_per_sector(stock_amounts: DataFrame, k: int, key_col: str = "bk_code") -> DataFrame:
    """The ``k`` stocks with the largest amount per sector (ties by code).

    ``row_number() <= k`` over a window partitioned by sector; Spark inserts a
    partial per-partition limit before the shuffle (window group limit), so
    only ``k`` candidates per sector and map task are shuffled.
    """
    w = Window.partitionBy(key_col).orderBy(F.desc("amount"), "code")
    return stock_amounts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- returns and regressions (X5, X6) ----------------------------------------

def sector_returns(px: DataFrame, key_col: str = "bk_code", period_col: str = "period") -> DataFrame:
    """Simple return close/previous close - 1 and ln(amount) per sector and period."""
    w = Window.partitionBy(key_col).orderBy(period_col)
    return px.select(key_col, period_col, "close", "amount",
                     (F.col("close") / F.lag("close").over(w) - 1).alias("ret"),
                     F.log("amount").alias("log_amount"))


def attention_panel(sai: DataFrame, returns: DataFrame, key_col: str = "bk_code") -> DataFrame:
    """X6 input: return, ln(amount), SAI and the previous period's SAI per sector and period."""
    w = Window.partitionBy(key_col).orderBy("period")
    s = sai.select(key_col, "period", F.col("n_posts").cast("double").alias("sai"),
                   F.lag("n_posts").over(w).cast("double").alias("sai_lag"))
    return s.join(returns.select(key_col, "period", "ret", "log_amount"), [key_col, "period"])


def attention_regression(sai: DataFrame, returns: DataFrame, key_col: str = "bk_code", y: str = "ret") -> DataFrame:
    """Per sector, OLS of ``y`` (the return ``ret`` or the trading amount
    ``log_amount``) on the previous period's SAI
    (slope, intercept, R², n) — built-in ``regr_*`` aggregates."""
    x = F.col("sai_lag")
    return attention_panel(sai, returns, key_col).groupBy(key_col).agg(
        F.regr_slope(F.col(y), x).alias("slope"), F.regr_intercept(F.col(y), x).alias("intercept"),
        F.regr_r2(F.col(y), x).alias("r2"), F.regr_count(F.col(y), x).alias("n_obs"))


def attention_correlation(sai: DataFrame, returns: DataFrame, key_col: str = "bk_code") -> DataFrame:
    """Per sector, correlation of SAI with the return and with ln(amount)."""
    return attention_panel(sai, returns, key_col).groupBy(key_col).agg(
        F.corr("ret", "sai").alias("corr_ret"), F.corr("log_amount", "sai").alias("corr_amount"),
        F.count(F.lit(1)).alias("n_obs"))


def pooled_regression(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """X6 with several regressors: pooled OLS (MLlib ``LinearRegression``,
    normal-equation solver) with standard errors, t and p values.

    The fit is one distributed aggregation (X'X and X'y); the result is one
    row per coefficient (k + 1 rows), built from the model summary.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip") \
        .transform(df.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double") for c in features])
                     .where(F.col("_y").isNotNull()))
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", fitIntercept=True).fit(data)
    sm = model.summary
    names = features + ["intercept"]
    coefs = list(model.coefficients) + [model.intercept]
    rows = [(n, float(c), float(se), float(t), float(p))
            for n, c, se, t, p in zip(names, coefs, sm.coefficientStandardErrors, sm.tValues, sm.pValues)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, t_value double, p_value double")
