"""Parsing landed raw data into rows.

Collection (HTTP, browsers) is outside Spark; these jobs start from landed
page bodies (``raw_pages``/payload tables) and turn them into rows with the
extractors of ``html`` and generators, so parsing is spread over all executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import py_slice
from . import html

BAR_DATA_RE = r'(?s)\{"data":"(.*?)"\}'


def sector_type_label(bk_type: str) -> str:
    """Validate the sector-type key and map it to its label."""
    if bk_type not in K.SECTOR_TYPES:
        raise ValueError(f"wrong bk_type {bk_type!r}, expected one of {list(K.SECTOR_TYPES)}")
    return K.SECTOR_TYPES[bk_type]


def extract_sector_links(pages: DataFrame, data_date: str, bk_type: str = "thshy",
                         html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Every anchor of a list page's sector block becomes a sector row.

    ``bk_code`` is ``href[-7:-1]``, ``bk_name`` the anchor text; source, type,
    ``use_flag=0`` and ``data_date`` (``yyyyMMdd``, passed in so reruns are
    repeatable) are constants. ``pos`` keeps the anchor order on the page.
    """
    label = sector_type_label(bk_type)
    keep = keep or []
    anchors = html.column(html.sector_anchors, "array<struct<href:string,text:string>>", html_col)
    return pages.select(*keep, F.posexplode(anchors).alias("pos", "a")).select(
        *keep, "pos",
        py_slice(F.col("a.href"), -7, -1).alias("bk_code"),
        F.col("a.text").alias("bk_name"),
        F.lit(K.SECTOR_SOURCE).alias("bk_source"),
        F.lit(label).alias("bk_type"),
        F.lit(0).alias("use_flag"),
        F.lit(data_date).alias("data_date"),
    )


def extract_constituents(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, dynamic: bool = True) -> DataFrame:
    """(code, name) rows of landed constituent pages, in page order.

    ``dynamic`` pages hold triples of anchors in a table body; the others hold
    pairs of anchors that open a new window.
    """
    read, step = (html.table_anchors, 3) if dynamic else (html.blank_anchors, 2)
    keep = keep or []
    return strided_rows(pages.select(*keep, html.column(read, "array<string>", html_col).alias("_a")), "_a", step, keep)


def strided_rows(df: DataFrame, arr_col: str, step: int, keep: list[str] | None = None) -> DataFrame:
    """Cut a flat list into records of ``step`` items and keep the
    first two as (code, name); ``idx`` is the 0-based record number.

    Only records whose name exists are emitted. For pairs this is exactly the
    original loop (it runs over complete pairs, so an odd last item is
    skipped); for triples the original fails on a one-item tail, which is
    skipped here instead. An empty list gives no rows.
    """
    keep = keep or []
    a = F.col(arr_col)
    recs = F.when(F.size(a) > 1, F.transform(
        F.sequence(F.lit(0), F.size(a) - 2, F.lit(step)),
        lambda i: F.struct((i / step).cast("int").alias("idx"), F.get(a, i).alias("code"),
                           F.get(a, i + 1).alias("name"))))
    return df.select(*keep, F.inline(recs))


ANCHOR_RE = r'<a href="([^"]*)">([^<]*)</a>'


def anchor_texts(html_col: Column | str) -> Column:
    """Texts of all plain anchors of a page, in order."""
    h = F.col(html_col) if isinstance(html_col, str) else html_col
    return F.regexp_extract_all(h, F.lit(ANCHOR_RE), 2)


def parse_bars(payloads: DataFrame, code_col: str = "bk_code", body_col: str = "body",
               with_rejects: bool = False) -> DataFrame:
    """Parse JSONP bar payloads into ``sector_daily`` rows.

    First ``{"data":"..."}`` match (dot matches newlines), split on ``;``, then
    on ``,``: a date and six numbers, further fields ignored. One job covers
    every (sector, year) payload; no driver loop. ``with_rejects`` adds the
    rows that cannot be loaded, with ``row``, ``pos`` and the ``reason``
    (NULL for good rows): no_code, no_payload, ragged, bad_date, bad_number.
    """
    body = F.col(body_col)
    data = F.when(body.rlike(BAR_DATA_RE), F.regexp_extract(body, BAR_DATA_RE, 1))
    rows = payloads.select(F.col(code_col).alias("bk_code"), F.posexplode_outer(F.split(data, ";")).alias("pos", "row"))
    rows = rows.withColumn("row", F.trim(F.regexp_replace("row", r"[\r\n]+", "")))
    rows = rows.where(F.col("row").isNull() | (F.col("row") != ""))  # a last separator makes no row
    f = F.split("row", ",")
    nums = ["open", "high", "low", "close", "vol", "amount"]
    values = [F.get(f, i + 1).try_cast("double") for i in range(len(nums))]
    day = F.get(f, 0)
    bad_date = ~day.rlike(r"^\d{8}$") | F.try_to_timestamp(day, F.lit("yyyyMMdd")).isNull()
    reason = (F.when(F.col("bk_code").isNull(), "no_code").when(F.col("row").isNull(), "no_payload")
              .when(F.size(f) < 1 + len(nums), "ragged").when(bad_date, "bad_date")
              .when(F.greatest(*(v.isNull() | F.isnan(v) for v in values)), "bad_number"))
    out = rows.select("bk_code", day.alias("trade_date"), *(v.alias(c) for v, c in zip(values, nums)), "pos", "row", reason.alias("reason"))
    return out if with_rejects else out.where("reason is null").drop("pos", "row", "reason")


def parse_post_time(text: Column | str, year: Column | int | str) -> Column:
    """P5: ``MM-dd HH:mm`` text of a listing page plus the year -> TIMESTAMP_NTZ.

    One-digit month/day/hour parts are accepted as the original parser does;
    an impossible date (29 Feb of a common year) gives NULL instead of an error.
    """
    t = F.col(text) if isinstance(text, str) else text
    y = F.lit(year) if isinstance(year, (int, str)) else year
    s = F.concat(y.cast("string"), F.lit("-"), F.trim(t))
    fmt = "yyyy-M-d H:mm"
    return F.when(F.try_to_timestamp(s, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(s, F.lit(fmt)))


def post_year_from_fetch(text: Column | str, fetched_at: Column | str) -> Column:
    """P5 year [our choice]: listing pages show ``MM-dd HH:mm`` without a year.
    A post cannot be newer than the page fetch, so a time that would lie after
    it belongs to the previous year. 29 February is sought in the last leap year."""
    f = F.col(fetched_at) if isinstance(fetched_at, str) else fetched_at
    this = parse_post_time(text, F.year(f))
    return F.when(this.isNull(), F.year(f) - F.pmod(F.year(f), F.lit(4))).otherwise(F.year(f) - F.when(this > f, 1).otherwise(0))


# ---- forum listing pages (P1) -----------------------------------------------

def parse_forum_page(pages: DataFrame, year: int | Column | str, html_col: str = "html",
                     keep: list[str] | None = None, fetched_col: str = "fetched_at") -> DataFrame:
    """A landed listing page to posts: time, title (the anchor's ``title``
    attribute) and author; blocks without a title are skipped. ``pos`` is the
    block's place on the page (page order = newest first); ``time_text`` stays,
    and ``dtime`` is NULL where it cannot be read.

    ``year``: an int or Column, or ``"fetch"`` to infer each post's year from
    the page's ``fetched_col`` (see ``post_year_from_fetch``).
    """
    keep = list(keep or [])
    by_fetch = isinstance(year, str) and year == "fetch"
    also = [fetched_col] if by_fetch and fetched_col not in keep else []
    posts = html.column(html.forum_posts, "array<struct<pos:int,time_text:string,title:string,author:string>>", html_col)
    rows = pages.select(*keep, *also, F.inline(posts))
    y = post_year_from_fetch("time_text", fetched_col) if by_fetch else year
    return rows.select(*keep, *also, "pos", parse_post_time("time_text", y).alias("dtime"), "time_text", "title", "author")


def extract_page_items(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """P1 on generic landed pages: the whole texts of title, h1 and paragraphs in
    page order, as (kind, pos, text), nested tags included and entities decoded."""
    keep = keep or []
    items = html.column(html.text_items, "array<struct<kind:string,text:string>>", html_col)
    return pages.select(*keep, F.posexplode(items).alias("pos", "it")).select(*keep, "pos", "it.kind", "it.text")
