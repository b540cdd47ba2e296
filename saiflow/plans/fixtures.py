"""Stand-in inputs derived from the driver tables.

The driver tables hold no forum data, so each logical input (posts, prices,
sectors, ...) is a view over them. Every view exists twice: as a Spark
DataFrame (``spark_views``) and as DuckDB SQL (``DUCK``) for the oracle. Both
give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import read_table

# posts per listing page in the page-order stand-in
PAGE_SIZE = 80


# Latin letters as Han letters; the last sign ends a word, so no word begins another.
LATIN, HAN, HAN_END = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人和", "了"


def to_han(word):
    return F.concat(F.translate(F.lower(word), LATIN, HAN), F.lit(HAN_END))


class Views:
    """Lazily built stand-in DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    # posts ---------------------------------------------------------------
    def posts_ev(self) -> DataFrame:
        return self.t("events").select(
            F.col("event_type").alias("code"), F.col("ts").alias("dtime"), F.col("props").alias("title"),
            F.col("user_id").cast("string").alias("author"), F.col("event_id").alias("ord"))

    def posts_doc(self) -> DataFrame:
        return self.t("documents").select(
            F.col("source").alias("code"), F.col("text").alias("title"), F.col("lang").alias("author"),
            F.col("doc_id").alias("ord"))

    def posts_li(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_suppkey").alias("code"),
                                         F.col("l_shipdate").cast("date").alias("trade_date"))

    def posts_pages(self) -> DataFrame:
        """posts_ev cut into listing pages of PAGE_SIZE posts, newest first
        (ids rise with time; the top id is one scalar aggregate)."""
        ev = self.posts_ev()
        top = ev.agg(F.max("ord")).scalar()
        return ev.withColumn("page_no", (F.floor((top - F.col("ord")) / PAGE_SIZE) + 1).cast("int"))

    # sectors and market ----------------------------------------------------
    def constituents(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_nationkey").alias("bk_code"), F.col("s_suppkey").alias("code"),
                                         F.col("s_name").alias("name"))

    def sectors(self) -> DataFrame:
        n, r = self.t("nation"), self.t("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("bk_code"), F.col("n_name").alias("bk_name"), F.col("r_name").alias("bk_type"))

    def stock_px(self) -> DataFrame:
        return self.t("events").groupBy(F.col("event_type").alias("ts_code"), F.col("ts").cast("date").alias("trade_date")) \
            .agg(F.max_by("value", "event_id").alias("close"), F.sum("value").alias("amount"))

    def bars(self) -> DataFrame:
        return self.t("events").groupBy(F.col("event_type").alias("bk_code"), F.col("ts").cast("date").alias("trade_date")) \
            .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
                 F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
                 F.count(F.lit(1)).alias("vol"), F.sum("value").alias("amount"))

    def sector_px(self) -> DataFrame:
        o, c = self.t("orders"), self.t("customer")
        return o.join(c, o.o_custkey == c.c_custkey).groupBy(
            F.col("c_nationkey").alias("bk_code"),
            F.date_trunc("month", "o_orderdate").cast("date").alias("period")) \
            .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.sum("o_totalprice").alias("amount"))

    def posts_stock(self) -> DataFrame:
        """Documents as posts about stocks: the supplier numbered by the id, on a day of January."""
        d = self.t("documents")
        return d.select((F.col("doc_id") % 100 + 1).alias("code"), F.col("text").alias("title"),
                        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"))

    def han_words(self) -> DataFrame:
        """Words of the part names in Han letters, each with a last sign of its own."""
        w = self.t("part").select(F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''").distinct()
        return w.select(to_han(F.col("w")).alias("word"), F.col("w").alias("latin"))

    def han_titles(self) -> DataFrame:
        """Part names written without spaces, with a term of the full lexicon after some of them."""
        p = self.t("part")
        words = F.filter(F.split("p_name", " "), lambda w: w != "")
        return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("latin"),
                        F.array_join(F.transform(words, to_han), "").alias("title"))

    def lexicon(self) -> DataFrame:
        """Words of the benchmark texts and part names as terms, with a side by their length."""
        words = self.t("benchmark").select(F.explode(F.split("text", " ")).alias("term"))
        words = words.unionByName(self.t("part").select(F.col("p_name").alias("term"))).where("term <> ''").distinct()
        return words.select("term", F.when(F.length("term") % 2 == 0, "put").otherwise("call").alias("side"))

    def dense(self) -> DataFrame:
        """Part names in Han letters without any sign between words."""
        return self.t("part").select(F.col("p_partkey").alias("ord"), F.translate(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), LATIN, HAN).alias("title"))

    def pieces(self) -> DataFrame:
        """word, freq: the words of the part names as often as they occur, and each with the first letter of the next, once."""
        w = F.split(F.translate(F.lower("p_name"), LATIN, HAN), " ")
        words = self.t("part").select(F.explode(w).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
        glued = self.t("part").select(w.alias("w")).where(F.size("w") > 1).select(F.concat(F.col("w")[0], F.left(F.col("w")[1], F.lit(1))).alias("word"))
        return words.unionByName(glued.distinct().select("word", F.lit(1).cast("long").alias("freq")))

    def tagged(self) -> DataFrame:
        """The events of each user in order. Errors and purchases have a tag of their own; what other words are
        depends on whether they follow one of these."""
        w = Window.partitionBy("user_id").orderBy("event_id")
        ends = F.col("event_type").isin("error", "purchase")
        tag = F.when(ends, "a").when(F.lag(ends, 1, True).over(w), "v").otherwise("n")
        return self.t("events").select(F.col("user_id").alias("sentence"), F.col("event_id").alias("i"), F.col("event_type").alias("word"), tag.alias("tag"))

    def calendar(self) -> DataFrame:
        """Weekdays of January 2024 (the events span)."""
        return self.spark.range(1).select(
            F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("trade_date")) \
            .where(F.weekday("trade_date") < 5)


# DuckDB bodies of the same views (used inside WITH clauses by the oracle).
DUCK = {
    "posts_ev": "select event_type as code, ts as dtime, props as title, cast(user_id as varchar) as author, "
                "event_id as ord from events",
    "posts_doc": "select source as code, text as title, lang as author, doc_id as ord from documents",
    "posts_li": "select l_suppkey as code, cast(l_shipdate as date) as trade_date from lineitem",
    "posts_pages": "select event_type as code, ts as dtime, props as title, cast(user_id as varchar) as author, "
                   "event_id as ord, cast(floor(((select max(event_id) from events) - event_id) / "
                   f"{PAGE_SIZE}) + 1 as integer) as page_no from events",
    "constituents": "select s_nationkey as bk_code, s_suppkey as code, s_name as name from supplier",
    "sectors": "select n_nationkey as bk_code, n_name as bk_name, r_name as bk_type from nation "
               "join region on n_regionkey = r_regionkey",
    "stock_px": "select event_type as ts_code, cast(ts as date) as trade_date, max_by(value, event_id) as close, "
                "sum(value) as amount from events group by event_type, cast(ts as date)",
    "bars": "select event_type as bk_code, cast(ts as date) as trade_date, min_by(value, event_id) as open, "
            "max(value) as high, min(value) as low, max_by(value, event_id) as close, count(*) as vol, "
            "sum(value) as amount from events group by event_type, cast(ts as date)",
    "sector_px": "select c_nationkey as bk_code, cast(date_trunc('month', o_orderdate) as date) as period, "
                 "max_by(o_totalprice, o_orderkey) as close, sum(o_totalprice) as amount from orders "
                 "join customer on o_custkey = c_custkey group by c_nationkey, "
                 "cast(date_trunc('month', o_orderdate) as date)",
    "posts_stock": "select doc_id % 100 + 1 as code, text as title, date '2024-01-01' + cast(doc_id % 30 as integer) as day from documents",
    "han_titles": "select p_partkey as ord, p_name as latin, (select string_agg(translate(lower(w), "
                  f"'{LATIN}', '{HAN}') || '{HAN_END}', '' order by i) from (select unnest(string_split(p_name, ' ')) as w, "
                  "unnest(range(0, len(string_split(p_name, ' ')))) as i) where w <> '') as title from part",
    "lexicon": "select term, case when length(term) % 2 = 0 then 'put' else 'call' end as side from (select distinct term from "
               "(select unnest(string_split(text, ' ')) as term from benchmark union all select p_name from part) where term <> '')",
    "dense": f"select p_partkey as ord, translate(lower(replace(p_name, ' ', '')), '{LATIN}', '{HAN}') as title from part",
    "pieces": f"select word, count(*) as freq from (select unnest(string_split(translate(lower(p_name), '{LATIN}', '{HAN}'), ' ')) as word from part) "
              f"where word <> '' group by word union all select distinct w[1] || left(w[2], 1), 1 from "
              f"(select string_split(translate(lower(p_name), '{LATIN}', '{HAN}'), ' ') as w from part) where len(w) > 1",
    "tagged": "select user_id as sentence, event_id as i, event_type as word, case when event_type in ('error', 'purchase') then 'a' "
              "when lag(event_type in ('error', 'purchase'), 1, true) over (partition by user_id order by event_id) then 'v' else 'n' end as tag from events",
    "calendar": "select cast(d as date) as trade_date from (select unnest(generate_series(date '2024-01-01', "
                "date '2024-01-31', interval 1 day)) as d) where isodow(d) < 6",
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named stand-in views for DuckDB."""
    return "with " + ", ".join(f"{n} as ({DUCK[n]})" for n in names) + " "
