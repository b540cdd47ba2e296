"""Query catalogue: every operator as a runnable query on the driver tables,
each paired with an independent DuckDB SQL oracle (None = rows-only check).

A query is ``fn(spark, sf_dir) -> DataFrame``. Column names are aliased the
same way on both sides; floating results are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import to_yyyymmdd
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import index as X
from ..operators import labels as L
from ..operators import load as D
from ..operators import market as M
from ..operators import parse as P
from ..operators import text as N
from ..session import drop_scratch, scratch_path
from ..sources.files import read_terms
from ..sources.sql import param_sql
from .fixtures import DUCK, HAN, HAN_END, LATIN, Views, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str | None] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return deco


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Floating columns as both engines give them; operators keep full precision."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- fixture parameters (test stand-ins, not the original's constants) -------
CODE = "click"
PX_CODE, PX_LO, PX_HI = "purchase", "2024-01-05", "2024-01-25"
HOUSE, NEWS_SUFFIX = "de", "r"          # stand-ins for the house/news accounts
MIN_CHARS = 20
SPLIT_STORED, SPLIT_NEW = "2024-01-20", "2024-01-15"
BEARISH, BULLISH = ["###", "$"], ["License", "free"]
STOPWORDS = ["the", "of", "and", "a", "to", "in", "de", "la", "le", "et", "el", "en", "der", "die", "und"]
FIRST_CHAR_STOPWORDS = ["a", "e", "t", "É", "the", "und"]
DATA_DATE = "20230901"
VIEW_START = "2024-01-10"
HIST_BINS = 20


# ---- scans, filters ------------------------------------------------------------

@query("scan_posts", with_views("posts_ev") + "select code, dtime, title, author, ord from posts_ev")
def q_scan_posts(spark, d):
    return Views(spark, d).posts_ev()


@query("filter_code", with_views("posts_ev") + f"select ord, dtime, author from posts_ev where code = '{CODE}'")
def q_filter_code(spark, d):
    return C.filter_code(Views(spark, d).posts_ev(), CODE).select("ord", "dtime", "author")


_PX_SQL = ("select ts_code, trade_date, close, round(amount, 6) as amount from stock_px "
           "where ts_code = {c} and trade_date between {lo} and {hi}")


@query("param_sql_read", with_views("stock_px") + _PX_SQL.format(
    c=f"'{PX_CODE}'", lo=f"date '{PX_LO}'", hi=f"date '{PX_HI}'"))
def q_param_sql_read(spark, d):
    import datetime as dt
    return param_sql(spark, _PX_SQL.replace("from stock_px", "from {{stock_px}}").format(c=":code", lo=":lo", hi=":hi"),
                     {"code": PX_CODE, "lo": dt.date.fromisoformat(PX_LO), "hi": dt.date.fromisoformat(PX_HI)},
                     stock_px=Views(spark, d).stock_px())


@query("price_range_scan", with_views("stock_px") + _PX_SQL.format(
    c="'view'", lo=f"date '{PX_LO}'", hi=f"date '{PX_HI}'"))
def q_price_range_scan(spark, d):
    px = Views(spark, d).stock_px()
    return px.where((F.col("ts_code") == "view") & F.col("trade_date").between(F.lit(PX_LO).cast("date"),
                                                                               F.lit(PX_HI).cast("date"))) \
             .select("ts_code", "trade_date", "close", F.round("amount", 6).alias("amount"))


@query("filter_special_chars", with_views("posts_doc") +
       "select ord, code, author, title from posts_doc where not regexp_matches(title, '[【】$]')")
def q_filter_special_chars(spark, d):
    return C.filter_special_chars(Views(spark, d).posts_doc()).select("ord", "code", "author", "title")


# Stock-name stand-in: the part types, lower-cased, each listed at its first
# part key, concatenated in that order ("economysmall..."); titles are part names.
_NAMES_DUCK = ("names as (select string_agg(t, '' order by o) as s from "
               "(select lower(p_type) as t, min(p_partkey) as o from part group by lower(p_type)))")


def _names(v: Views) -> DataFrame:
    return v.t("part").groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("ord"))


def _titles(v: Views) -> DataFrame:
    return v.t("part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))


@query("filter_name_overlap",
       f"with {_NAMES_DUCK} select p_partkey as ord, p_name as title from part, names "
       "where not exists (select 1 from range(1, length(p_name) - 2) r(i) "
       "where contains(names.s, substr(p_name, cast(i as integer), 4)))")
def q_filter_name_overlap(spark, d):
    v = Views(spark, d)
    return C.filter_name_overlap(_titles(v), C.name_grams(_names(v)))


@query("longest_name_match",
       f"with {_NAMES_DUCK}, subs as (select p_partkey, cast(i as integer) as i, cast(l as integer) as l "
       "from part, names, range(1, length(p_name) + 1) a(i), range(1, length(p_name) + 1) b(l) "
       "where i + l - 1 <= length(p_name) and contains(names.s, substr(p_name, cast(i as integer), cast(l as integer)))), "
       "best as (select p_partkey, arg_max(i, l * 100000 - i) as i, max(l) as l from subs group by p_partkey) "
       "select p.p_partkey as ord, coalesce(substr(p.p_name, b.i, b.l), '') as max_sub, coalesce(b.l, 0) as max_len "
       "from part p left join best b on p.p_partkey = b.p_partkey")
def q_longest_name_match(spark, d):
    v = Views(spark, d)
    return C.longest_name_match(_titles(v), _names(v), ["ord"])


@query("filter_authors", with_views("posts_doc") +
       f"select ord, code, author from posts_doc where author <> '{HOUSE}' and not ends_with(author, '{NEWS_SUFFIX}')")
def q_filter_authors(spark, d):
    return C.filter_authors(Views(spark, d).posts_doc(), HOUSE, NEWS_SUFFIX).select("ord", "code", "author")


@query("drop_incomplete",
       "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id "
       "where l.quality is not null and l.toxic is not null")
def q_drop_incomplete(spark, d):
    v = Views(spark, d)
    j = v.t("documents").select("doc_id", "lang").join(v.t("labels"), "doc_id", "left")
    return C.drop_incomplete(j)


@query("filter_short_posts", with_views("posts_doc") +
       f"select ord, code, author from posts_doc where length(title) >= {MIN_CHARS}")
def q_filter_short_posts(spark, d):
    return C.filter_short_posts(Views(spark, d).posts_doc(), MIN_CHARS).select("ord", "code", "author")


@query("clean_posts", with_views("posts_doc") +
       "select ord, code, author from posts_doc where title is not null and author is not null "
       f"and not regexp_matches(title, '[【】$]') and author <> '{HOUSE}' and not ends_with(author, '{NEWS_SUFFIX}')")
def q_clean_posts(spark, d):
    return C.clean_posts(Views(spark, d).posts_doc(), HOUSE, NEWS_SUFFIX).select("ord", "code", "author")


@query("filter_session_hours", with_views("posts_ev") +
       "select ord, dtime from posts_ev where strftime(dtime, '%H:%M:%S.%f') > '09:00:00.000000' "
       "and strftime(dtime, '%H:%M:%S.%f') < '17:00:00.000000'")
def q_filter_session_hours(spark, d):
    return C.filter_session_hours(Views(spark, d).posts_ev()).select("ord", "dtime")


@query("pages_until_cutoff", with_views("posts_pages") +
       ", pm as (select page_no, min(dtime) as oldest from posts_pages where page_no >= 3 group by page_no), "
       "ff as (select coalesce(min(page_no), 2147483647) as f from pm "
       "where oldest <= timestamp '2024-01-20 13:10:00') "
       "select ord, page_no from posts_pages, ff where page_no >= 3 and page_no < ff.f")
def q_pages_until_cutoff(spark, d):
    return C.pages_until_cutoff(Views(spark, d).posts_pages(), "2024-01-20", start_page=3).select("ord", "page_no")


@query("pages_by_count", with_views("posts_pages") +
       "select ord, page_no from posts_pages where page_no between 5 and 14")
def q_pages_by_count(spark, d):
    return C.pages_by_count(Views(spark, d).posts_pages(), 5, 10).select("ord", "page_no")


# ---- dedup, union, loads -------------------------------------------------------

@query("dedup_posts", with_views("posts_doc") + "select distinct code, title, author from posts_doc")
def q_dedup_posts(spark, d):
    return D.dedup_posts(Views(spark, d).posts_doc().select("code", "title", "author"), ["code", "title", "author"])


@query("union_batches", with_views("posts_pages") +
       "select distinct code, dtime, title, author from ("
       "select code, dtime, title, author from posts_pages where page_no <= 60 union all "
       "select code, dtime, title, author from posts_pages where page_no >= 50)")
def q_union_batches(spark, d):
    p = Views(spark, d).posts_pages().select("code", "dtime", "title", "author", "page_no")
    u = D.union_batches(p.where(F.col("page_no") <= 60).drop("page_no"), p.where(F.col("page_no") >= 50).drop("page_no"))
    return D.dedup_posts(u)


_STORED = f"dtime < timestamp '{SPLIT_STORED}'"
_NEW = f"dtime >= timestamp '{SPLIT_NEW}'"


@query("insert_if_absent", with_views("posts_ev") +
       f", st as (select * from posts_ev where {_STORED}), nw as (select * from posts_ev where {_NEW}) "
       "select distinct code, dtime, title, author from nw where not exists (select 1 from st where "
       "st.code = nw.code and st.dtime = nw.dtime and st.title = nw.title and st.author = nw.author)")
def q_insert_if_absent(spark, d):
    ev = Views(spark, d).posts_ev().drop("ord")
    return D.insert_if_absent(ev.where(F.col("dtime") >= F.lit(SPLIT_NEW).cast("timestamp_ntz")),
                              ev.where(F.col("dtime") < F.lit(SPLIT_STORED).cast("timestamp_ntz")))


@query("append_until_conflict", with_views("posts_ev") +
       f", st as (select * from posts_ev where {_STORED}), "
       f"nw as (select code, dtime, title, author, min(-ord) as pos from posts_ev where {_NEW} "
       "group by code, dtime, title, author), "
       "fc as (select min(pos) as f from nw where exists (select 1 from st where st.code = nw.code and "
       "st.dtime = nw.dtime and st.title = nw.title and st.author = nw.author)) "
       "select code, dtime, title, author from nw, fc where fc.f is null or nw.pos < fc.f")
def q_append_until_conflict(spark, d):
    ev = Views(spark, d).posts_ev().withColumn("pos", -F.col("ord")).drop("ord")
    new = ev.where(F.col("dtime") >= F.lit(SPLIT_NEW).cast("timestamp_ntz"))
    stored = ev.where(F.col("dtime") < F.lit(SPLIT_STORED).cast("timestamp_ntz")).drop("pos")
    return D.append_until_conflict(new, stored, "pos").drop("pos")


@query("incremental_backfill", with_views("posts_ev") +
       f", st as (select * from posts_ev where {_STORED} and code <> 'error'), "
       "nw as (select distinct p.code, p.dtime, p.title, p.author from posts_ev p "
       "where year(p.dtime) = 2024 and strftime(p.dtime, '%H:%M:%S.%f') > '09:00:00.000000' "
       "and strftime(p.dtime, '%H:%M:%S.%f') < '17:00:00.000000') "
       "select * from nw where not exists (select 1 from st where st.code = nw.code and st.dtime = nw.dtime "
       "and st.title = nw.title and st.author = nw.author)")
def q_incremental_backfill(spark, d):
    ev = Views(spark, d).posts_ev().drop("ord")
    stored = ev.where((F.col("dtime") < F.lit(SPLIT_STORED).cast("timestamp_ntz")) & (F.col("code") != "error"))
    return D.incremental_backfill(ev, stored, 2024)  # posts of stored days and codes too, as far as they are not stored


_BAR_COLS = "bk_code, trade_date, open, high, low, close, vol, amount"


@query("upsert_bars", with_views("bars") +
       ", b as (select bk_code, strftime(trade_date, '%Y%m%d') as trade_date, open, high, low, close, "
       "cast(vol as double) as vol, round(amount, 6) as amount from bars), "
       "st as (select * from b where trade_date < '20240120'), "
       "nw as (select bk_code, trade_date, open, high, low, round(close * 1.5, 6) as close, vol, amount "
       "from b where trade_date >= '20240115') "
       f"select {_BAR_COLS} from st where not exists (select 1 from nw where nw.bk_code = st.bk_code "
       f"and nw.trade_date = st.trade_date) union all select {_BAR_COLS} from nw")
def q_upsert_bars(spark, d):
    b = _bars_text(Views(spark, d))
    stored = b.where(F.col("trade_date") < "20240120")
    new = b.where(F.col("trade_date") >= "20240115").withColumn("close", F.round(F.col("close") * 1.5, 6))
    # the batch holds an older copy of every bar and bars without a key
    old = new.withColumn("close", F.col("close") - 1).withColumn("vol", F.lit(None).cast("double"))
    batch = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2))) \
               .unionByName(new.withColumn("bk_code", F.lit(None).cast("string")).withColumn("seq", F.lit(3)))
    return D.upsert(stored, batch, ["bk_code", "trade_date"], "seq")


def _bars_text(v: Views) -> DataFrame:
    return v.bars().select("bk_code", to_yyyymmdd("trade_date").alias("trade_date"), "open", "high", "low", "close",
                           F.col("vol").cast("double").alias("vol"), F.round("amount", 6).alias("amount"))


# ---- parsing landed data ---------------------------------------------------------

_ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def _esc(c):
    """Text as page markup: entities for the signs that need them."""
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("$"), F.lit("&#36;"))


def _page(rows: DataFrame, group: list, before: str, after: str) -> DataFrame:
    """One page of each group: its rows' markup (columns ord, m) between noise."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "m"))), lambda x: x["m"]), "\n")
    pages = rows.groupBy(*group).agg(F.concat(F.lit(before), body, F.lit(after)).alias("html"))
    # landed pages lie in many files; the few bytes of a group-by would be drawn into one task
    return pages.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# suppliers of one nation whose keys share their hundreds are a page
_LIST_PAGE = 100


_NOISE = '<html><head><title>x &lt; y</title><script>var a="</a><a href=\'/no/\'>";</script></head><body><nav><a href="/nav/1/">no</a></nav>'


@query("extract_sector_links", with_views("sectors") +
       "select bk_type as page, cast(row_number() over (partition by bk_type order by bk_code) - 1 as integer) as pos, "
       "right('000000' || bk_code, 6) as bk_code, bk_name || ' & ' || bk_type || ' $' as bk_name, "
       "'同花顺' as bk_source, '行业板块' as bk_type, 0 as use_flag, "
       f"'{DATA_DATE}' as data_date from sectors")
def q_extract_sector_links(spark, d):
    """List pages built from the sectors, with other anchors around the sector block, and read back."""
    v = Views(spark, d)
    name = F.concat_ws("", "bk_name", F.lit(" & "), "bk_type", F.lit(" $"))
    code = F.lpad(F.col("bk_code").cast("string"), 6, "0")
    m = F.concat(F.lit("<div><a class='c' href='http://q.x.cn/thshy/detail/code/"), code, F.lit("/' target=_blank><b>"),
                 F.substring(_esc(name), 1, 3), F.lit("</b>"), F.expr("substring({0}, 4)".format("_e")), F.lit("</a></div>"))
    rows = v.sectors().withColumn("_e", _esc(name)).select(F.col("bk_type").alias("page"), F.col("bk_code").alias("ord"), m.alias("m"))
    pages = _page(rows, ["page"], _NOISE + '<div class="cate_inner visible">', '</div><a href="/foot/">no</a></body></html>')
    return P.extract_sector_links(pages, DATA_DATE, "thshy", keep=["page"])


@query("parse_constituents",
       f"select s_nationkey as bk_code, s_suppkey // {_LIST_PAGE} as page_no, cast(row_number() over (partition by s_nationkey, s_suppkey // {_LIST_PAGE} "
       "order by s_suppkey) - 1 as integer) as idx, "
       "right('000000' || s_suppkey, 6) as code, s_name || ' <A&B>' as name from supplier")
def q_parse_constituents(spark, d):
    """Constituent pages: three anchors a stock in a table body, with noise around, and read back."""
    s = Views(spark, d).t("supplier")
    code, name = F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), _esc(F.concat("s_name", F.lit(" <A&B>")))
    m = F.concat(F.lit('<tr><td>1</td><td><a target="_blank" href="/c/">'), code, F.lit("</a></td><td><a href='/n/' target='_blank'><i>"), name,
                 F.lit('</i></a></td><td><a href="#" title="a>b">+</a></td></tr>'))
    rows = s.select(F.col("s_nationkey").alias("bk_code"), F.expr(f"s_suppkey div {_LIST_PAGE}").alias("page_no"), F.col("s_suppkey").alias("ord"), m.alias("m"))
    pages = _page(rows, ["bk_code", "page_no"], _NOISE + '<div class="body m-pager-box"><table><thead><tr><th><a href="/sort">no</a></th></tr></thead><tbody>',
                  '</tbody></table></div><div class="m-pager"><a target="_blank">no</a></div></body></html>')
    return P.extract_constituents(pages, keep=["bk_code", "page_no"])


@query("parse_constituents_static",
       f"select s_nationkey as bk_code, s_suppkey // {_LIST_PAGE} as page_no, cast(row_number() over (partition by s_nationkey, s_suppkey // {_LIST_PAGE} "
       "order by s_suppkey) - 1 as integer) as idx, "
       "right('000000' || s_suppkey, 6) as code, s_name as name from supplier")
def q_parse_constituents_static(spark, d):
    s = Views(spark, d).t("supplier")
    m = F.concat(F.lit("<a href=/c/ target=_blank>"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"),
                 F.lit('</a> <a href="/no/">no</a> <a data-x="1" target="_blank" href="/n/">'), _esc(F.col("s_name")), F.lit("</a>"))
    rows = s.select(F.col("s_nationkey").alias("bk_code"), F.expr(f"s_suppkey div {_LIST_PAGE}").alias("page_no"), F.col("s_suppkey").alias("ord"), m.alias("m"))
    return P.extract_constituents(_page(rows, ["bk_code", "page_no"], _NOISE, "</body></html>"), keep=["bk_code", "page_no"], dynamic=False)


@query("parse_forum_pages", with_views("posts_pages") +
       ", p as (select *, row_number() over (partition by page_no order by ord desc) - 1 as pos from posts_pages) "
       "select page_no, cast(pos as integer) as pos, date_trunc('minute', dtime) as dtime, "
       "title || ' & $\"q\" <1>' as title, ' ' || author as author from p where ord % 11 <> 0")
def q_parse_forum_pages(spark, d):
    """Listing pages built from the posts (some blocks without a title), fetched in February, and read back."""
    p = Views(spark, d).posts_pages()
    title = _esc(F.concat("title", F.lit(' & $"q" <1>')))
    quoted = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('title="'), title, F.lit('"'))).otherwise(
        F.concat(F.lit("class=x title='"), F.replace(title, F.lit("'"), F.lit("&#39;")), F.lit("'")))
    link = F.when(F.col("ord") % 11 == 0, F.lit("<a href='/n'>")).otherwise(F.concat(F.lit("<a href='/n/1' "), quoted, F.lit(">")))
    m = F.concat(F.lit("<div class='articleh normal_post odd'><span class='l1 a1'>7</span><span class=\"l3 a3\"><em>hot</em>"), link,
                 F.lit("short</a></span><span class='l4 a4'><a href='/u'><font color=red> <b>"), F.substring("author", 1, 1), F.lit("</b>"),
                 F.expr("substring(author, 2)"), F.lit("</font></a></span><span class='l5 a5'>"), F.date_format("dtime", "MM-dd HH:mm"), F.lit("</span></div>"))
    pages = _page(p.select("page_no", (-F.col("ord")).alias("ord"), m.alias("m")), ["page_no"], _NOISE + "<div id='articlelistnew'><div class='dheader'>",
                  "</div></div><div class='normal_post'><span class='l3 a3'><a title='no'>no</a></span></div></body></html>")
    pages = pages.withColumn("fetched_at", F.lit("2024-02-03 08:00:00").cast("timestamp_ntz"))
    out = P.parse_forum_page(pages, "fetch", keep=["page_no"])
    return out.drop("fetched_at", "time_text")


def _strided_sql(step: int) -> str:
    return (f"with a as (select page_id, regexp_extract_all(html, '{_ANCHOR}', 2) as arr from pages), "
            f"s as (select page_id, arr, unnest(range(0, len(arr) - 1, {step})) as i from a) "
            f"select page_id, cast(i // {step} as integer) as idx, arr[i + 1] as code, arr[i + 2] as name from s")


@query("strided_pairs", _strided_sql(2))
def q_strided_pairs(spark, d):
    pages = Views(spark, d).t("pages").select("page_id", P.anchor_texts("html").alias("arr"))
    return P.strided_rows(pages, "arr", 2, keep=["page_id"])


@query("strided_triples", _strided_sql(3))
def q_strided_triples(spark, d):
    pages = Views(spark, d).t("pages").select("page_id", P.anchor_texts("html").alias("arr"))
    return P.strided_rows(pages, "arr", 3, keep=["page_id"])


# in the oracle a paragraph ends where the next one starts
@query("extract_page_items",
       "with c as (select page_id, replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<p>', '</p><p>') as h from pages), "
       "r as (select page_id, unnest(regexp_extract_all(h, '(?s)<(title|h1|p)>(.*?)</(?:title|h1|p|article)>', 1)) as kind, "
       "unnest(regexp_extract_all(h, '(?s)<(title|h1|p)>(.*?)</(?:title|h1|p|article)>', 2)) as t, "
       "unnest(range(0, len(regexp_extract_all(h, '(?s)<(title|h1|p)>(.*?)</(?:title|h1|p|article)>', 1)))) as pos from c) "
       "select page_id, cast(pos as integer) as pos, kind, replace(replace(replace(replace(replace(replace(replace("
       "regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&#39;', chr(39)), "
       "'&amp;', '&') as text from r")
def q_extract_page_items(spark, d):
    return P.extract_page_items(Views(spark, d).t("pages"), keep=["page_id"])


@query("parse_bars", with_views("bars") +
       "select bk_code, strftime(trade_date, '%Y%m%d') as trade_date, open, high, low, close, "
       "cast(vol as double) as vol, round(amount, 6) as amount from bars")
def q_parse_bars(spark, d):
    """Payloads are built from the bars (one per sector and year, the shape
    the quote server returns) and parsed back."""
    return P.parse_bars(_payloads(_bars_text(Views(spark, d))))


def _payloads(b: DataFrame) -> DataFrame:
    row = F.concat_ws(",", "trade_date", *[F.col(c).cast("string") for c in ["open", "high", "low", "close", "vol", "amount"]])
    return b.groupBy("bk_code", F.substring("trade_date", 1, 4).alias("year")).agg(
        F.concat(F.lit('quotebridge_v4_line({"data":"'),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", row.alias("r")))),
                                          lambda x: x["r"]), ";"),
                 F.lit('"})')).alias("body"))


# what is wrong with order k: nothing, or one of seven defects
_REJECT_SQL = ("case o_orderkey % 8 when 1 then 'no_code' when 2 then 'no_payload' when 3 then 'no_payload' when 4 then 'ragged' "
               "when 5 then 'bad_date' when 6 then 'bad_number' when 7 then 'bad_number' end")


@query("parse_bars_rejects",
       "select case when reason = 'no_code' then null else cast(o_orderkey as varchar) end as bk_code, reason, "
       "case when reason is null then strftime(o_orderdate, '%Y%m%d') end as trade_date, "
       "case when reason is null then o_totalprice end as close from "
       f"(select o_orderkey, o_orderdate, o_totalprice, {_REJECT_SQL} as reason from orders)")
def q_parse_bars_rejects(spark, d):
    """A payload of one bar for each order, most of them spoilt in one of seven ways."""
    k, day, px = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_totalprice").cast("string")
    first = F.when(k == 5, F.lit("20240231")).otherwise(day)
    fields = F.concat_ws(",", first, F.when(k == 6, F.lit("x1")).otherwise(px), px, px, px, F.when(k == 7, F.lit("")).otherwise(F.lit("1")), px)
    row = F.when(k == 4, F.concat_ws(",", day, px)).otherwise(fields)
    body = F.when(k == 2, F.lit(None)).when(k == 3, F.lit("error 403")).otherwise(F.concat(F.lit('f({"data":"'), row, F.lit(';\n"})')))
    code = F.when(k != 1, F.col("o_orderkey").cast("string"))
    parsed = P.parse_bars(Views(spark, d).t("orders").select(code.alias("bk_code"), body.alias("body")), with_rejects=True)
    good = F.col("reason").isNull()
    return parsed.select("bk_code", "reason", F.when(good, F.col("trade_date")).alias("trade_date"),
                         F.when(good, F.col("close")).alias("close"))


_POST_YEAR = 2023


@query("parse_post_time",
       f"select o_orderkey, strftime(o_orderdate, '%m-%d %H:%M') as post_time, "
       f"try_strptime('{_POST_YEAR}-' || strftime(o_orderdate, '%m-%d %H:%M'), '%Y-%m-%d %H:%M') as dtime from orders")
def q_parse_post_time(spark, d):
    o = Views(spark, d).t("orders").select("o_orderkey", F.date_format("o_orderdate", "MM-dd HH:mm").alias("post_time"))
    return o.withColumn("dtime", P.parse_post_time("post_time", _POST_YEAR))


@query("format_trade_date",
       "select o_orderkey, replace(cast(cast(o_orderdate as date) as varchar), '-', '') as trade_date, "
       "strftime(o_orderdate, '%Y%m%d') as trade_date_fmt from orders")
def q_format_trade_date(spark, d):
    o = Views(spark, d).t("orders")
    return o.select("o_orderkey", F.replace(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.lit(""))
                    .alias("trade_date"), to_yyyymmdd("o_orderdate").alias("trade_date_fmt"))


# ---- aggregates ----------------------------------------------------------------

@query("posts_per_author", with_views("posts_ev") + "select author, count(*) as n_posts from posts_ev group by author")
def q_posts_per_author(spark, d):
    return A.posts_per_author(Views(spark, d).posts_ev())


@query("author_histogram", with_views("posts_ev") +
       ", c as (select author, count(*) as n from posts_ev group by author), "
       "s as (select min(n) as lo, max(n) as hi from c), "
       f"b as (select least(case when s.lo = s.hi then ((c.n - s.lo) * 2 * {HIST_BINS} + {HIST_BINS}) // 2 "
       f"else ((c.n - s.lo) * {HIST_BINS}) // (s.hi - s.lo) end, {HIST_BINS - 1}) as bin from c, s), "
       "g as (select cast(unnest(range(0, 20)) as integer) as bin), "
       "e as (select case when lo = hi then lo - 0.5 else cast(lo as double) end as l0, "
       "case when lo = hi then 1.0 else cast(hi - lo as double) end as w from s) "
       f"select g.bin, round(e.l0 + g.bin * e.w / {HIST_BINS}, 6) as left_edge, "
       f"round(e.l0 + (g.bin + 1) * e.w / {HIST_BINS}, 6) as right_edge, "
       "(select count(*) from b where b.bin = g.bin) as n_authors from g, e")
def q_author_histogram(spark, d):
    h = A.author_histogram(A.posts_per_author(Views(spark, d).posts_ev(), ordered=False), "n_posts", HIST_BINS)
    return _rounded(h, 6, "left_edge", "right_edge")


_DAILY = "select code, cast(dtime as date) as trade_date, count(*) as n_posts from posts_ev group by code, cast(dtime as date)"


@query("daily_post_volume", with_views("posts_ev") + _DAILY)
def q_daily_post_volume(spark, d):
    return A.daily_post_volume(Views(spark, d).posts_ev())


@query("daily_volume_trade_days", with_views("posts_ev", "calendar") +
       f"select * from ({_DAILY}) x where trade_date in (select trade_date from calendar)")
def q_daily_volume_trade_days(spark, d):
    v = Views(spark, d)
    return A.on_trade_days(A.daily_post_volume(v.posts_ev()), v.calendar())


def _attention_sql(how: str) -> str:
    cnt = "coalesce(x.n_posts, 0)" if how == "right" else "x.n_posts"
    return (with_views("posts_ev", "calendar", "stock_px") +
            f", x as (select * from ({_DAILY}) y where trade_date in (select trade_date from calendar)), "
            "p as (select ts_code as code, trade_date, close from stock_px "
            f"where trade_date between date '{PX_LO}' and date '{PX_HI}') "
            f"select p.code, strftime(p.trade_date, '%Y%m%d') as trade_date, {cnt} as n_posts, p.close, "
            "row_number() over (partition by p.code order by p.trade_date) - 1 as idx "
            f"from x {'right' if how == 'right' else 'inner'} join p on x.code = p.code and x.trade_date = p.trade_date")


def _attention(spark, d, how):
    v = Views(spark, d)
    daily = A.on_trade_days(A.daily_post_volume(v.posts_ev()), v.calendar())
    px = v.stock_px().where(F.col("trade_date").between(F.lit(PX_LO).cast("date"), F.lit(PX_HI).cast("date")))
    return X.attention_vs_close(daily, px, how)


@query("attention_vs_close", _attention_sql("inner"))
def q_attention_vs_close(spark, d):
    return _attention(spark, d, "inner")


@query("attention_vs_close_all_days", _attention_sql("right"))
def q_attention_vs_close_all_days(spark, d):
    return _attention(spark, d, "right")


@query("viewpoints_by_day", with_views("posts_ev") +
       "select cast(dtime as date) as dt, row_number() over (partition by cast(dtime as date) order by ord) - 1 as pos, "
       "case when ord % 7 = 0 then null else title end as viewpoint from posts_ev "
       f"where cast(dtime as date) >= date '{VIEW_START}'")
def q_viewpoints_by_day(spark, d):
    text = F.when(F.col("ord") % 7 != 0, F.col("title"))  # some opinions are empty cells
    ev = Views(spark, d).posts_ev().select(F.col("dtime").cast("date").alias("dt"), text.alias("viewpoint"), "ord")
    return A.viewpoints_by_day(ev, VIEW_START)


# sector_info stand-in that grows with the data: one sector row per supplier
# (a sector listed again and again, like daily snapshots of the list)
_SECTOR_INFO_DUCK = ("sector_info as (select s.s_nationkey as bk_code, n.n_name as bk_name, '同花顺' as bk_source, "
                     "r.r_name as bk_type, 0 as use_flag, cast(s.s_suppkey as varchar) as data_date from supplier s "
                     "join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey)")


@query("distinct_sectors", f"with {_SECTOR_INFO_DUCK} "
       "select distinct bk_code from sector_info where bk_source = '同花顺' and bk_type = 'ASIA'")
def q_distinct_sectors(spark, d):
    v = Views(spark, d)
    info = v.t("supplier").join(v.sectors(), F.col("s_nationkey") == F.col("bk_code")).select(
        "bk_code", "bk_name", F.lit("同花顺").alias("bk_source"), "bk_type", F.lit(0).alias("use_flag"),
        F.col("s_suppkey").cast("string").alias("data_date"))
    return M.distinct_sectors(info, "同花顺", "ASIA")


@query("coverage_check", with_views("bars", "calendar") +
       ", per as (select substr(strftime(trade_date, '%Y%m%d'), 1, 4) as year, bk_code, count(*) as n_bars "
       "from bars group by 1, 2), ex as (select strftime(trade_date, '%Y') as year, count(*) as expected "
       "from calendar group by 1) select per.year, per.bk_code, per.n_bars, ex.expected, "
       "per.n_bars = ex.expected as complete from per left join ex on per.year = ex.year")
def q_coverage_check(spark, d):
    v = Views(spark, d)
    return M.coverage_check(_bars_text(v), v.calendar())


# ---- labels ----------------------------------------------------------------------

def _contains_sql(terms):
    return "(" + " or ".join(f"contains(title, '{t}')" for t in terms) + ")"


_LABEL_CASE = (f"case when {{p}} and not {{c}} then 'put' when not {{p}} and {{c}} then 'call' else 'unknown' end")


@query("lexicon_label", with_views("posts_doc") +
       f"select ord, {_LABEL_CASE.format(p=_contains_sql(BEARISH), c=_contains_sql(BULLISH))} as label from posts_doc")
def q_lexicon_label(spark, d):
    return L.lexicon_label(Views(spark, d).posts_doc(), BEARISH, BULLISH).select("ord", "label")


@query("lexicon_term_counts", with_views("posts_doc") +
       ", t as (select * from (values ('put', '###'), ('put', '$'), ('call', 'License'), ('call', 'free')) v(side, term)) "
       "select side, term, (select count(*) from posts_doc where contains(title, t.term)) as n_titles from t")
def q_lexicon_term_counts(spark, d):
    return L.lexicon_term_counts(Views(spark, d).posts_doc(), BEARISH, BULLISH)


@query("lexicon_label_cumulative", with_views("posts_doc") +
       f", f as (select ord, {_contains_sql(BEARISH)} as hp, {_contains_sql(BULLISH)} as hc from posts_doc), "
       "m as (select min(case when hp then ord end) as fp, min(case when hc then ord end) as fc from f) "
       f"select ord, {_LABEL_CASE.format(p='coalesce(ord >= m.fp, false)', c='coalesce(ord >= m.fc, false)')} as label "
       "from f, m")
def q_lexicon_label_cumulative(spark, d):
    return L.lexicon_label_cumulative(Views(spark, d).posts_doc(), "ord", BEARISH, BULLISH).select("ord", "label")


_FULL = [("put", t) for t in K.BEARISH_TERMS] + [("call", t) for t in K.BULLISH_TERMS]
_FULL_DUCK = ("lexicon as (select * from (values " + ", ".join(f"({i}, '{side}', '{t}')" for i, (side, t) in enumerate(_FULL)) + ") v(i, side, term)), "
              "lex_posts as (select h.ord, case when h.ord % 3 = 0 then h.title else h.title || x.term || h.title end as title "
              f"from han_titles h join lexicon x on x.i = h.ord % {len(_FULL)})")


def _lexicon_posts(v: Views) -> DataFrame:
    """Han titles, two thirds of them with a term of the full lexicon inside."""
    terms = F.array(*[F.lit(t) for _, t in _FULL])
    term = F.get(terms, (F.col("ord") % len(_FULL)).cast("int"))
    return v.han_titles().select("ord", F.when(F.col("ord") % 3 == 0, F.col("title")).otherwise(F.concat("title", term, "title")).alias("title"))


def _lexicon_files(spark: SparkSession) -> tuple[list[str], list[str]]:
    """The full lexicon, written as term files with stray white space and read back."""
    out = []
    for side in ("put", "call"):
        path = scratch_path(spark, f"lexicon-{side}-{uuid.uuid4().hex}")
        lines = [(f"\t{t}\u3000 ",) for s, t in _FULL if s == side] + [("  ",)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
        out.append([r.term for r in read_terms(spark, path).collect()])  # hand-made lists of tens of terms
        drop_scratch(spark, path)
    return out[0], out[1]


@query("lexicon_label_full", with_views("han_titles") + ", " + _FULL_DUCK +
       ", f as (select p.ord, bool_or(x.side = 'put' and contains(p.title, x.term)) as hp, "
       "bool_or(x.side = 'call' and contains(p.title, x.term)) as hc from lex_posts p, lexicon x group by p.ord) "
       f"select ord, {_LABEL_CASE.format(p='hp', c='hc')} as label from f")
def q_lexicon_label_full(spark, d):
    put, call = _lexicon_files(spark)
    return L.lexicon_label(_lexicon_posts(Views(spark, d)), put, call).select("ord", "label")


@query("lexicon_term_counts_full", with_views("han_titles") + ", " + _FULL_DUCK +
       ", n as (select x.i, count(*) as n from lex_posts p join lexicon x on contains(p.title, x.term) group by x.i) "
       "select x.side, x.term, coalesce(n.n, 0) as n_titles from lexicon x left join n on n.i = x.i")
def q_lexicon_term_counts_full(spark, d):
    put, call = _lexicon_files(spark)
    return L.lexicon_term_counts(_lexicon_posts(Views(spark, d)), put, call)


# ---- text ------------------------------------------------------------------------

_HAN = f"translate(lower(w), '{LATIN}', '{HAN}') || '{HAN_END}'"
# words of a title in order; its nouns are the words with an even number of letters
_HAN_WORDS = ("hw as (select p_partkey as ord, unnest(string_split(p_name, ' ')) as w, "
              "unnest(range(0, len(string_split(p_name, ' ')))) as i from part)")


def _han_dictionary(v: Views) -> list[str]:
    return [r.word for r in v.han_words().collect()]  # the words that part names are made of: tens


def _han_pos(v: Views) -> DataFrame:
    return v.han_words().select("word", F.when(F.length("latin") % 2 == 0, "n").otherwise("x").alias("tag"))


@query("segment_titles", f"with {_HAN_WORDS} select ord, count(*) as n_tokens, string_agg({_HAN}, ' ' order by i) as tokens "
       "from hw where w <> '' group by ord")
def q_segment_titles(spark, d):
    v = Views(spark, d)
    t = N.tokenize_posts(v.han_titles(), "title", _han_dictionary(v))
    return t.select("ord", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("sector_keywords_han", f"with {_HAN_WORDS} select p.p_partkey as bk_code, coalesce((select string_agg({_HAN}, ' ' order by i) from hw "
       "where hw.ord = p.p_partkey and w <> '' and length(w) % 2 = 0), '') as keywords from part p")
def q_sector_keywords_han(spark, d):
    v = Views(spark, d)
    out = N.sector_keywords(v.han_titles().select(F.col("ord").alias("bk_code"), F.col("title").alias("bk_name")), _han_pos(v), ("n",),
                            dictionary=_han_dictionary(v))
    return out.select("bk_code", F.array_join("keywords", " ").alias("keywords"))


# a word's vector: the embedding numbered by its letters
_VEC_NO = "(length(w) * 31 + ascii(w) * 7 + ascii(right(w, 1))) % 100"


@query("title_similarity", f"with {_HAN_WORDS}, n as (select ord, w from hw where w <> '' and length(w) % 2 = 0), "
       "a as (select e.embedding as v from embeddings e where e.vec_id = 0) "
       "select n.ord, round_even(avg({cos}), 3) + 0.0 as similarity from n join embeddings e on e.vec_id = ".replace("{cos}", "__COS__") +
       _VEC_NO + ", a group by n.ord")
def q_title_similarity(spark, d):
    """Titles -> segmentation -> nouns -> mean similarity to an anchor word."""
    v = Views(spark, d)
    e = v.t("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    w = v.han_words().withColumn("w", F.col("latin")).withColumn("vec_id", F.expr(_VEC_NO).cast("long"))
    vectors = w.join(e, "vec_id").select("word", "vec").unionByName(e.where("vec_id = 0").select(F.lit("锚").alias("word"), "vec"))
    out = N.title_similarity(v.han_titles(), _han_dictionary(v), _han_pos(v), vectors, "锚", ("n",), "ord")
    return out

_TOK = r"regexp_extract_all(title, '[\p{L}\p{N}]+')"


@query("tokenize_posts", with_views("posts_doc") +
       f"select ord, len({_TOK}) as n_tokens, array_to_string({_TOK}, ' ') as tokens from posts_doc")
def q_tokenize_posts(spark, d):
    t = N.tokenize_posts(Views(spark, d).posts_doc())
    return t.select("ord", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def _sw_list(words):
    return "[" + ", ".join(f"'{w}'" for w in list(dict.fromkeys(words + ["XXX", "YYY"]))) + "]"


@query("remove_stopwords", with_views("posts_doc") +
       f", t as (select ord, list_filter({_TOK}, lambda x: not list_contains({_sw_list(STOPWORDS)}, x)) as k "
       "from posts_doc) select ord, len(k) as n_tokens, array_to_string(k, ' ') as tokens from t")
def q_remove_stopwords(spark, d):
    t = N.remove_stopwords(N.tokenize_posts(Views(spark, d).posts_doc()), STOPWORDS)
    return t.select("ord", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("remove_stopwords_first_char", with_views("posts_doc") +
       f", t as (select ord, list_filter({_TOK}, lambda x: not list_contains({_sw_list(FIRST_CHAR_STOPWORDS)}, "
       "substr(x, 1, 1))) as k from posts_doc) "
       "select ord, len(k) as n_tokens, array_to_string(k, ' ') as tokens from t")
def q_remove_stopwords_first_char(spark, d):
    t = N.remove_stopwords(N.tokenize_posts(Views(spark, d).posts_doc()), FIRST_CHAR_STOPWORDS, first_char=True)
    return t.select("ord", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("pad_sequence_40", with_views("posts_doc") +
       "select ord, array_to_string(list_transform(range(1, 41), lambda i: case when i <= length(title) "
       "then unicode(substr(title, cast(i as integer), 1)) else 0 end), ',') as seq from posts_doc")
def q_pad_sequence_40(spark, d):
    t = N.pad_sequence(Views(spark, d).posts_doc())
    return t.select("ord", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query("sector_keywords",
       "with pos as (select distinct lower(p_type) as word from part), "
       "t as (select p_partkey, unnest(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+')) as w, "
       "unnest(range(0, len(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+')))) as i from part) "
       "select p.p_partkey as bk_code, coalesce((select string_agg(w, ' ' order by i) from t where "
       "t.p_partkey = p.p_partkey and t.w in (select word from pos)), '') as keywords from part p")
def q_sector_keywords(spark, d):
    part = Views(spark, d).t("part")
    sectors = part.select(F.col("p_partkey").alias("bk_code"), F.col("p_name").alias("bk_name"))
    pos = part.select(F.lower("p_type").alias("word"), F.lit("n").alias("tag"))
    out = N.sector_keywords(sectors, pos, ("n",))
    return out.select("bk_code", F.array_join("keywords", " ").alias("keywords"))


def _cos_sql(a, b):
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


ORACLE["title_similarity"] = ORACLE["title_similarity"].replace("__COS__", _cos_sql("e.embedding", "a.v"))


@query("anchor_similarity",
       "with a as (select embedding as v from embeddings where vec_id = 0) "
       f"select label, (round_even(avg({_cos_sql('embedding', 'a.v')}), 3) + 0.0) as similarity "
       "from embeddings, a group by label")
def q_anchor_similarity(spark, d):
    e = Views(spark, d).t("embeddings")
    words = e.select(F.col("label").alias("post_id"), F.col("vec_id").cast("string").alias("word"))
    vectors = e.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    return N.anchor_similarity(words, vectors, "0").withColumnRenamed("post_id", "label")


_TOK_RE = r"[\p{L}\p{N}]+"
_BAYES_SQL = (
    "with docs as (select cast(l.quality as integer) as c, d.text as t from documents d join labels l "
    "on d.doc_id = l.doc_id where d.text is not null and l.quality is not null), "
    "pri as (select c, count(*) as n_c from docs group by c), "
    f"nwc as (select w, c, count(*) as n_wc from (select c, unnest(regexp_extract_all(t, '{_TOK_RE}')) as w from docs) "
    "group by w, c), "
    "pc as (select c, sum(n_wc) as n_words from nwc group by c), "
    "v as (select count(*) as v from (select distinct w from nwc)), "
    "grid as (select x.w, y.c from (select distinct w from nwc) x, (select c from pri) y), "
    "lp as (select g.w, g.c, ln((cast(coalesce(n.n_wc, 0) as double) + 1.0) / "
    "(cast(pc.n_words as double) + cast(v.v as double))) as lp "
    "from grid g left join nwc n on g.w = n.w and g.c = n.c join pc on g.c = pc.c, v), "
    f"tf as (select doc_id, w, count(*) as tf from (select doc_id, unnest(regexp_extract_all(text, '{_TOK_RE}')) as w "
    "from documents where text is not null) group by doc_id, w), "
    "s as (select tf.doc_id, lp.c, sum(tf.tf * lp.lp) as ll from tf join lp on tf.w = lp.w group by tf.doc_id, lp.c), "
    "lpr as (select c, ln(n_c / (select sum(n_c) from pri)) as lpc from pri), "
    "sc as (select d.doc_id, lpr.c, lpr.lpc + coalesce(s.ll, 0) as sc from (select doc_id from documents "
    "where text is not null) d cross join lpr left join s on s.doc_id = d.doc_id and s.c = lpr.c), "
    "pv as (select doc_id, max(case when c = 0 then sc end) - max(case when c = 1 then sc end) as d from sc group by doc_id), "
    "pr as (select doc_id, case when d >= 0 then exp(-d) / (1 + exp(-d)) else 1 / (1 + exp(d)) end as p from pv) "
    "select case when p > 0.5 then 1 else 0 end as sentiment_label, "
    "case when p > 0.5 then 'positive' else 'negative' end as sentiment_key, "
    "round(p, 4) + 0.0 as positive_probs, round(1 - p, 4) + 0.0 as negative_probs, d.text "
    "from pr join documents d on pr.doc_id = d.doc_id")


@query("score_sentiment", _BAYES_SQL)
def q_score_sentiment(spark, d):
    """N4 with an exact-vocabulary naive Bayes (DataFrame aggregates) trained
    on the labelled documents (label = quality) and applied to all documents."""
    v = Views(spark, d)
    docs = v.t("documents").select("doc_id", "text")
    train = docs.join(v.t("labels").select("doc_id", "quality"), "doc_id")
    prior, words = L.fit_token_bayes(train, "text", "quality")
    return _rounded(L.score_token_bayes(prior, words, docs, "doc_id", "text"), 4, "positive_probs", "negative_probs")


# DuckDB rounds a tiny negative value to -0.0 where Spark's decimal rounding
# gives 0.0; "+ 0.0" turns -0.0 into 0.0 so both engines emit the same value.

# ---- indices ---------------------------------------------------------------------

@query("top_stocks_per_sector",
       "with a as (select s.s_nationkey as bk_code, s.s_suppkey as code, round(sum(l.l_extendedprice), 4) as amount "
       "from lineitem l join supplier s on l.l_suppkey = s.s_suppkey group by 1, 2), "
       "r as (select *, row_number() over (partition by bk_code order by amount desc, code) as rank from a) "
       "select * from r where rank <= 2")
def q_top_stocks_per_sector(spark, d):
    v = Views(spark, d)
    amt = v.t("lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.sum("l_extendedprice").alias("amount"))
    sa = amt.join(v.constituents(), "code").select("bk_code", "code", F.round("amount", 4).alias("amount"))
    return X.top_stocks_per_sector(sa, 2).withColumn("rank", F.col("rank").cast("long"))


_SAI_SQL = (with_views("posts_li", "constituents") +
            ", c as (select c.bk_code, cast(date_trunc('month', p.trade_date) as date) as period, count(*) as n "
            "from posts_li p join constituents c on p.code = c.code group by 1, 2), "
            "rng as (select min(cast(date_trunc('month', trade_date) as date)) as lo, "
            "max(cast(date_trunc('month', trade_date) as date)) as hi from posts_li), "
            "g as (select b.bk_code, cast(unnest(generate_series(rng.lo, rng.hi, interval 1 month)) as date) as period "
            "from (select distinct bk_code from constituents) b, rng), "
            "sai as (select g.bk_code, g.period, coalesce(c.n, 0) as n_posts from g left join c "
            "on g.bk_code = c.bk_code and g.period = c.period) ")


_SAI_PX_SQL = _SAI_SQL.replace("with ", f"with sector_px as ({DUCK['sector_px']}), ", 1)


def _sai(v: Views) -> DataFrame:
    return X.sector_attention(v.posts_li(), v.constituents(), period="month")


@query("sector_attention", _SAI_SQL + "select * from sai")
def q_sector_attention(spark, d):
    return _sai(Views(spark, d))


@query("abnormal_attention", _SAI_SQL +
       "select bk_code, period, n_posts, round(ln(1 + n_posts) - ln(1 + quantile_cont(n_posts, 0.5) over "
       "(partition by bk_code order by period rows between 5 preceding and 1 preceding)), 6) + 0.0 as abnormal from sai")
def q_abnormal_attention(spark, d):
    return _rounded(X.abnormal_attention(_sai(Views(spark, d)), 5), 6, "abnormal")


_DOC_DAY = "date '2024-01-01' + cast(ord % 30 as integer)"


@query("sentiment_attention", with_views("posts_doc") +
       f", l as (select code, {_DOC_DAY} as day, "
       f"{_LABEL_CASE.format(p=_contains_sql(BEARISH), c=_contains_sql(BULLISH))} as label from posts_doc) "
       "select code, day, count(*) as n_posts, count(*) filter (where label = 'put') as n_put, "
       "count(*) filter (where label = 'call') as n_call, "
       "round(ln((count(*) filter (where label = 'call') + 1) / (count(*) filter (where label = 'put') + 1)), 6) + 0.0 as bullish "
       "from l group by code, day")
def q_sentiment_attention(spark, d):
    p = Views(spark, d).posts_doc().withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"),
                                                                 (F.col("ord") % 30).cast("int")))
    return _rounded(X.sentiment_attention(L.lexicon_label(p, BEARISH, BULLISH), "code", "day"), 6, "bullish")


_RET_SQL = (", ret as (select bk_code, period, close, amount, "
            "close / lag(close) over (partition by bk_code order by period) - 1 as ret, "
            "ln(amount) as log_amount from sector_px) ")


@query("sector_returns", with_views("sector_px") + _RET_SQL +
       "select bk_code, period, close, round(amount, 4) as amount, round(ret, 9) + 0.0 as ret, round(log_amount, 9) + 0.0 as log_amount from ret")
def q_sector_returns(spark, d):
    r = X.sector_returns(Views(spark, d).sector_px())
    return _rounded(_rounded(r, 4, "amount"), 9, "ret", "log_amount")


_PANEL_SQL = (_SAI_PX_SQL + _RET_SQL +
              ", s as (select bk_code, period, cast(n_posts as double) as sai, cast(lag(n_posts) over (partition by bk_code order by period) as double) "
              "as sai_lag from sai), pan as (select s.*, r.ret, r.log_amount from s join ret r on s.bk_code = r.bk_code and s.period = r.period) ")


def _regr_sql(y: str) -> str:
    return (_PANEL_SQL + f"select bk_code, round(regr_slope({y}, sai_lag), 9) + 0.0 as slope, round(regr_intercept({y}, sai_lag), 6) + 0.0 as intercept, "
            f"round(regr_r2({y}, sai_lag), 6) + 0.0 as r2, cast(regr_count({y}, sai_lag) as bigint) as n_obs from pan group by bk_code")


def _regression(spark, d, y):
    v = Views(spark, d)
    r = X.attention_regression(_sai(v), X.sector_returns(v.sector_px()), y=y)
    return _rounded(_rounded(r, 6, "intercept", "r2"), 9, "slope")


@query("attention_regression", _regr_sql("ret"))
def q_attention_regression(spark, d):
    return _regression(spark, d, "ret")


@query("attention_regression_amount", _regr_sql("log_amount"))
def q_attention_regression_amount(spark, d):
    return _regression(spark, d, "log_amount")


@query("attention_correlation", _PANEL_SQL +
       "select bk_code, round(corr(ret, sai), 6) + 0.0 as corr_ret, round(corr(log_amount, sai), 6) + 0.0 as corr_amount, count(*) as n_obs "
       "from pan group by bk_code")
def q_attention_correlation(spark, d):
    v = Views(spark, d)
    return _rounded(X.attention_correlation(_sai(v), X.sector_returns(v.sector_px())), 6, "corr_ret", "corr_amount")


@query("pooled_regression", _PANEL_SQL +
       ", q as (select ret as y, sai_lag as a, log_amount as b from pan where ret is not null and sai_lag is not null), "
       "m as (select var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as byy, "
       "avg(a) as ma, avg(b) as mb, avg(y) as my from q), "
       "fit as (select (ay * bb - byy * ab) / (aa * bb - ab * ab) as ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) as cb, ma, mb, my from m) "
       "select 'sai_lag' as term, round(ca, 8) + 0.0 as coef from fit union all select 'log_amount', round(cb, 8) + 0.0 from fit "
       "union all select 'intercept', round(my - ca * ma - cb * mb, 6) + 0.0 from fit")
def q_pooled_regression(spark, d):
    v = Views(spark, d)
    fit = X.pooled_regression(X.attention_panel(_sai(v), X.sector_returns(v.sector_px())), "ret", ["sai_lag", "log_amount"])
    digits = F.when(F.col("term") == "intercept", F.round("coef", 6)).otherwise(F.round("coef", 8))
    return fit.select("term", digits.alias("coef"))


_TOP_DUCK = ("amt as (select s.s_nationkey as bk_code, s.s_suppkey as code, sum(l.l_extendedprice) as amount from lineitem l "
             "join supplier s on l.l_suppkey = s.s_suppkey group by 1, 2), "
             "reps as (select bk_code, code from (select *, row_number() over (partition by bk_code order by round(amount, 4) desc, code) as r "
             "from amt) where r <= 2)")


def _representative(v: Views) -> DataFrame:
    amt = v.t("lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.sum("l_extendedprice").alias("amount"))
    sa = amt.join(v.constituents(), "code").select("bk_code", "code", F.round("amount", 4).alias("amount"))
    return X.top_stocks_per_sector(sa, 2).select("bk_code", "code")


# weekdays of the post dates: the trading calendar of the order years
_WEEKDAYS_DUCK = "days as (select distinct cast(l_shipdate as date) as trade_date from lineitem where isodow(cast(l_shipdate as date)) < 6)"


@query("sector_attention_daily", with_views("posts_li") + f", {_TOP_DUCK}, {_WEEKDAYS_DUCK}, "
       "c as (select r.bk_code, p.trade_date as period, count(*) as n from posts_li p join reps r on p.code = r.code group by 1, 2) "
       "select b.bk_code, d.trade_date as period, coalesce(c.n, 0) as n_posts from (select distinct bk_code from reps) b cross join days d "
       "left join c on c.bk_code = b.bk_code and c.period = d.trade_date")
def q_sector_attention_daily(spark, d):
    """The index as stated: posts about a sector's stocks of the greatest trading amount, on trading days."""
    v = Views(spark, d)
    days = v.posts_li().select("trade_date").distinct().where(F.weekday("trade_date") < 5)
    return X.sector_attention(v.posts_li(), _representative(v), "day", calendar=days)


@query("sector_sentiment", with_views("posts_stock", "constituents") +
       f", l as (select code, day, {_LABEL_CASE.format(p=_contains_sql(BEARISH), c=_contains_sql(BULLISH))} as label from posts_stock), "
       "j as (select c.bk_code, l.day, l.label from l join constituents c on l.code = c.code) "
       "select bk_code, day, count(*) as n_posts, count(*) filter (where label = 'put') as n_put, "
       "count(*) filter (where label = 'call') as n_call, "
       "round(ln((count(*) filter (where label = 'call') + 1) / (count(*) filter (where label = 'put') + 1)), 6) + 0.0 as bullish "
       "from j group by bk_code, day")
def q_sector_sentiment(spark, d):
    v = Views(spark, d)
    return _rounded(X.sector_sentiment(L.lexicon_label(v.posts_stock(), BEARISH, BULLISH), v.constituents()), 6, "bullish")
