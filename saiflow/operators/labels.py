"""Sentiment labelling: lexicon labels (N3, G5, W1) and a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import contains_any
from ..session import staged


def _label(put: Column, call: Column) -> Column:
    return (F.when(put & ~call, F.lit(K.LABEL_PUT))
            .when(~put & call, F.lit(K.LABEL_CALL))
            .otherwise(F.lit(K.LABEL_UNKNOWN)))


def lexicon_flags(posts: DataFrame, bearish: Sequence[str] = K.BEARISH_TERMS,
                  bullish: Sequence[str] = K.BULLISH_TERMS, title_col: str = "title") -> DataFrame:
    """Per post: does the title hold a bearish / a bullish term (substring)."""
    return posts.withColumn("has_put", contains_any(title_col, bearish)) \
                .withColumn("has_call", contains_any(title_col, bullish))


def lexicon_label(posts: DataFrame, bearish: Sequence[str] = K.BEARISH_TERMS,
                  bullish: Sequence[str] = K.BULLISH_TERMS, title_col: str = "title") -> DataFrame:
    """N3 (intended form): bearish only -> ``put``, bullish only -> ``call``,
    otherwise ``unknown``; each post is judged on its own title."""
    f = lexicon_flags(posts, bearish, bullish, title_col)
    return f.withColumn("label", _label(F.col("has_put"), F.col("has_call"))).drop("has_put", "has_call")


def lexicon_label_cumulative(posts: DataFrame, order_col: str, bearish: Sequence[str] = K.BEARISH_TERMS,
                             bullish: Sequence[str] = K.BULLISH_TERMS, title_col: str = "title") -> DataFrame:
    """W1 (literal form): the original sets its two flags once and never
    resets them, so after the first bearish (bullish) title every later post
    counts as bearish (bullish). Expressed as ``ord >= first hit`` with two
    scalar aggregates — no window over the whole table."""
    f = lexicon_flags(posts, bearish, bullish, title_col)
    # one scalar subquery (a single pass) yields both first-hit positions
    firsts = f.agg(F.struct(F.min(F.when(F.col("has_put"), F.col(order_col))).alias("p"),
                            F.min(F.when(F.col("has_call"), F.col(order_col))).alias("c")).alias("s")).scalar()
    o = F.col(order_col)
    put = F.coalesce(o >= F.col("_f.p"), F.lit(False))
    call = F.coalesce(o >= F.col("_f.c"), F.lit(False))
    return (f.withColumn("_f", firsts)          # bound once: one evaluation
             .withColumn("label", _label(put, call)).drop("has_put", "has_call", "_f"))


def lexicon_term_counts(posts: DataFrame, bearish: Sequence[str] = K.BEARISH_TERMS,
                        bullish: Sequence[str] = K.BULLISH_TERMS, title_col: str = "title") -> DataFrame:
    """Per lexicon term, how many titles contain it.

    One pass: a single global aggregate holds one counter per term (partial
    sums per task, one row per task shuffled), then the one result row is
    unpivoted to (side, term, n_titles). No join and no row explosion.
    """
    terms = [(K.LABEL_PUT, t) for t in bearish if t] + [(K.LABEL_CALL, t) for t in bullish if t]
    t = F.col(title_col)
    sums = posts.agg(*[F.count_if(F.coalesce(t.contains(term), F.lit(False))).alias(f"c{i}")
                       for i, (_, term) in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(term).alias("term"), F.col(f"c{i}").alias("n_titles"))
                     for i, (side, term) in enumerate(terms)])
    return sums.select(F.inline(rows))


# ---- naive Bayes as DataFrame operations (N4, exact vocabulary) -------------

_TOKEN_RE = r"[\p{L}\p{N}]+"
#: Words that every task holds when posts are scored (a few MB).
COMMON_WORDS = 20_000


def fit_token_bayes(train: DataFrame, text_col: str = "text", label_col: str = "label",
                    smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes over the exact tokens of labelled posts
    (labels 0/1), as plain aggregates. Returns ``(prior(d), words(w, n, d))``: one
    row with ln P(0) - ln P(1), and for every vocabulary word its count and ln P(w|0) -
    ln P(w|1), where P(w|c) = (n(w,c) + a) / (n(c) + a*V). Nothing is collected.
    """
    docs = train.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)) \
                .select(F.col(label_col).cast("int").alias("c"), F.col(text_col).alias("t"))
    n0, n1 = F.count_if(F.col("c") == 0), F.count_if(F.col("c") == 1)
    prior = docs.agg((F.log(n0) - F.log(n1)).alias("d"))
    counts = (docs.select("c", F.explode(F.regexp_extract_all("t", F.lit(_TOKEN_RE), 0)).alias("w"))
                  .groupBy("w").agg(n0.alias("n0"), n1.alias("n1")))
    total = counts.agg(F.struct(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("v")).alias("s")).scalar()

    def log_p(c: str) -> Column:
        return F.log((F.col(c) + smoothing) / (F.col(f"_s.{c}") + smoothing * F.col("_s.v")))

    return prior, counts.withColumn("_s", total).select("w", (F.col("n0") + F.col("n1")).alias("n"), (log_p("n0") - log_p("n1")).alias("d"))


def score_token_bayes(prior: DataFrame, words: DataFrame, posts: DataFrame, key_col: str,
                      text_col: str = "text") -> DataFrame:
    """Score posts with a model from ``fit_token_bayes``:
    sentiment_label, sentiment_key, positive_probs, negative_probs, text.

    Per post one sum over its tokens of the words' differences (words outside
    the vocabulary are ignored), plus the prior's; P(positive) is the logistic
    of that, written so that it never overflows.

    The ``COMMON_WORDS`` commonest words, which make up most tokens and the
    hot keys among them, go to all tasks; only the other tokens are shuffled
    to meet the rest of the vocabulary.
    """
    posts = posts.where(F.col(text_col).isNotNull())
    words = staged(words, "bayes-words")
    common = words.orderBy(F.desc("n"), "w").limit(COMMON_WORDS).select("w", "d")
    tokens = posts.select(key_col, F.explode(F.regexp_extract_all(text_col, F.lit(_TOKEN_RE), 0)).alias("w"))
    known = tokens.join(F.broadcast(common), "w").select(key_col, "d")
    other = tokens.join(F.broadcast(common.select("w")), "w", "left_anti").join(words.select("w", "d"), "w").select(key_col, "d")
    sums = known.unionByName(other).groupBy(key_col).agg(F.sum("d").alias("_d"))
    scored = posts.select(key_col, text_col).join(sums, key_col, "left").withColumn("_p0", prior.scalar())
    d = F.col("_p0") + F.coalesce("_d", F.lit(0.0))
    p1 = F.when(d >= 0, F.exp(-d) / (1 + F.exp(-d))).otherwise(1 / (1 + F.exp(d)))
    pos = F.col("_p") > 0.5
    return scored.withColumn("_p", p1).select(
        F.when(pos, 1).otherwise(0).alias("sentiment_label"),
        F.when(pos, F.lit("positive")).otherwise(F.lit("negative")).alias("sentiment_key"),
        F.col("_p").alias("positive_probs"), (1 - F.col("_p")).alias("negative_probs"),
        F.col(text_col).alias("text"))
