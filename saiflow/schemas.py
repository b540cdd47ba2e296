"""Explicit schemas of the tables the engine reads and writes.

Explicit schemas matter: an inferred all-digit stock code would become an
integer and lose its leading zeros.
"""

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("dtime", T.TimestampNTZType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
])
POST_KEYS = ["code", "dtime", "title", "author"]

RAW_PAGES = T.StructType([
    T.StructField("page_no", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

SECTOR_INFO = T.StructType([
    T.StructField("bk_code", T.StringType()),
    T.StructField("bk_name", T.StringType()),
    T.StructField("bk_source", T.StringType()),
    T.StructField("bk_type", T.StringType()),
    T.StructField("use_flag", T.IntegerType()),
    T.StructField("data_date", T.StringType()),
])

SECTOR_LIST_FILE = T.StructType([
    T.StructField("bk_code", T.StringType()),
    T.StructField("bk_name", T.StringType()),
])

CONSTITUENTS = T.StructType([
    T.StructField("bk_code", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
])

BAR_FIELDS = ["trade_date", "open", "high", "low", "close", "vol", "amount"]
SECTOR_DAILY = T.StructType(
    [T.StructField("bk_code", T.StringType()), T.StructField("trade_date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_FIELDS[1:]]
)
BAR_KEYS = ["bk_code", "trade_date"]

CALENDAR_FILE = T.StructType([T.StructField("trade_date", T.StringType())])

VIEWPOINTS = T.StructType([
    T.StructField("dt", T.StringType()),
    T.StructField("viewpoint", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("side", T.StringType()),
])

WORD_VECTORS = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])

SENTIMENT_OUTPUT = T.StructType([
    T.StructField("sentiment_label", T.IntegerType()),
    T.StructField("sentiment_key", T.StringType()),
    T.StructField("positive_probs", T.DoubleType()),
    T.StructField("negative_probs", T.DoubleType()),
    T.StructField("text", T.StringType()),
])
