"""Post filters and the stock-name overlap heuristic.

Every function maps a posts DataFrame (``code, dtime, title, author`` plus
any extra columns) to a filtered or enriched DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import micros_of_day_text
from ..session import staged


# ---- simple predicates ------------------------------------------------------

def filter_code(posts: DataFrame, code: str) -> DataFrame:
    """posts of one stock/board code (pushed to the parquet scan)."""
    return posts.where(F.col("code") == F.lit(code))


def special_chars_free(title: Column | str = "title", chars: str = K.SPECIAL_TITLE_CHARS) -> Column:
    """F2 predicate: the title holds none of ``chars``."""
    t = F.col(title) if isinstance(title, str) else title
    cls = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars) + "]"
    return ~t.rlike(cls)


def filter_special_chars(posts: DataFrame, chars: str = K.SPECIAL_TITLE_CHARS) -> DataFrame:
    """drop titles holding any of the notice characters."""
    return posts.where(special_chars_free("title", chars))


def author_ok(author: str = "author", house: str = K.HOUSE_ACCOUNT, suffix: str = K.NEWS_AUTHOR_SUFFIX) -> Column:
    """F4 predicate: not the house account and not a news account."""
    a = F.col(author)
    return (a != F.lit(house)) & ~a.endswith(F.lit(suffix))


def filter_authors(posts: DataFrame, house: str = K.HOUSE_ACCOUNT, suffix: str = K.NEWS_AUTHOR_SUFFIX) -> DataFrame:
    """drop posts of the house account and of accounts ending in ``suffix``."""
    return posts.where(author_ok("author", house, suffix))


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """drop rows with a null (or NaN) in any of ``subset`` (default: all columns)."""
    cols = subset or df.columns
    out = df.dropna(how="any", subset=cols)
    for c, t in df.select(*cols).dtypes:
        if t in ("double", "float"):
            out = out.where(~F.isnan(F.col(c)))
    return out


def filter_short_posts(posts: DataFrame, min_chars: int) -> DataFrame:
    """drop titles shorter than ``min_chars`` characters."""
    return posts.where(F.length("title") >= F.lit(min_chars))


def session_hours(ts: str = "dtime", start_s: int = K.SESSION_START_SECONDS,
                  end_s: int = K.SESSION_END_SECONDS) -> Column:
    """F7 predicate: time of day strictly inside (start, end)."""
    def hhmmss(sec):
        return f"{sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}.000000"
    t = micros_of_day_text(ts)
    return (t > F.lit(hhmmss(start_s))) & (t < F.lit(hhmmss(end_s)))


def filter_session_hours(posts: DataFrame, start_s: int = K.SESSION_START_SECONDS,
                         end_s: int = K.SESSION_END_SECONDS) -> DataFrame:
    """keep posts written strictly inside the trading session."""
    return posts.where(session_hours("dtime", start_s, end_s))


def clean_posts(posts: DataFrame, house: str = K.HOUSE_ACCOUNT, suffix: str = K.NEWS_AUTHOR_SUFFIX,
                chars: str = K.SPECIAL_TITLE_CHARS, name_grams: DataFrame | None = None) -> DataFrame:
    """F2-F6 in one pass: null title, notice characters, house/news authors,
    and (when ``name_grams`` is given) the stock-name overlap heuristic.

    The row predicates fuse into one codegen'd filter on the scan.
    """
    out = posts.where(F.col("title").isNotNull() & F.col("author").isNotNull()
                      & special_chars_free("title", chars) & author_ok("author", house, suffix))
    if name_grams is not None:
        out = filter_name_overlap(out, name_grams)
    return out


# ---- stock-name overlap (F3, C1) -------------------------------------------
#
# The original compares each title with ONE string made by concatenating all
# stock names, through an O(len1*len2) longest-common-substring table. Here the
# concatenated string is represented by its set of n-grams (built distributed,
# never as one string), and a title is an advert when it shares a gram of
# length NAME_OVERLAP_MIN with it:
# "LCS >= 4" <=> "some 4-character substring of the title occurs in the string".


def concat_grams(names: DataFrame, n_min: int, n_max: int, *, order_col: str = "ord",
                 name_col: str = "name", buckets: int = 256) -> DataFrame:
    """Distinct substrings (``gram``) of lengths n_min..n_max of the string made
    by concatenating all names in ``order_col`` order (numeric, unique), built
    without ever forming that string in one place.

    Each name contributes the grams that START inside it; those need the next
    ``n_max - 1`` characters after it, which come from the following names.
    Names are cut into ``buckets`` ranges of ``order_col`` (boundaries from one
    approximate-percentile scalar). Inside a range, a window over the next
    ``n_max - 1`` rows supplies the characters; across ranges, each range's
    first characters (its "head") are handed to the preceding ranges. Work per
    task is bounded by the range size and ``n_max``.
    """
    look = n_max - 1
    o, nmc = F.col(order_col), F.col(name_col)
    nm = names.where(F.length(nmc) > 0).select(o.alias("o"), nmc.alias("n"))
    probs = [i / buckets for i in range(1, buckets)]
    # distinct boundaries are actual values of `o`, so every range but the
    # last holds at least its boundary: range ids are consecutive, non-empty
    bounds = nm.agg(F.array_distinct(F.percentile_approx("o", probs, 10000)).alias("b")).scalar()
    nb = (nm.withColumn("_b", bounds)
            .withColumn("bk", F.size(F.filter("_b", lambda x: x < F.col("o")))).drop("_b"))
    w = Window.partitionBy("bk").orderBy("o")
    if look > 0:
        nxt = F.array_join(F.collect_list("n").over(w.rowsBetween(1, look)), "")
        # head of each range: its first `look` characters (from at most `look` names)
        heads = (nb.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= look)
                   .groupBy("bk").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("_h"))
                   .select("bk", F.substring(F.array_join(F.transform("_h", lambda x: x["n"]), ""), 1, look).alias("head")))
        # continuation after range b: heads of ranges b+1, b+2, ... (each holds
        # at least one character, so `look` ranges suffice)
        cont = (heads.select(F.explode(F.sequence(F.col("bk") - look, F.col("bk") - 1)).alias("tb"), "bk", "head")
                     .where(F.col("tb") >= 0)
                     .groupBy(F.col("tb").alias("bk"))
                     .agg(F.array_sort(F.collect_list(F.struct("bk", "head"))).alias("_c"))
                     .select("bk", F.substring(F.array_join(F.transform("_c", lambda x: x["head"]), ""), 1, look).alias("cont")))
        # at most `buckets` rows (one per range): broadcast, never shuffle on the range id
        ext = (nb.withColumn("_nx", nxt).join(F.broadcast(cont), "bk", "left")
                 .select("n", F.concat("n", F.substring(F.concat("_nx", F.coalesce("cont", F.lit(""))), 1, look)).alias("s")))
    else:
        ext = nb.select("n", F.col("n").alias("s"))
    pos = ext.select("n", "s", F.explode(F.sequence(F.lit(1), F.length("n"))).alias("_p"))
    grams = pos.select("s", "_p", F.explode(F.sequence(F.lit(n_min), F.lit(n_max))).alias("_l")) \
               .where(F.col("_p") + F.col("_l") - 1 <= F.length("s"))
    return grams.select(F.col("s").substr(F.col("_p"), F.col("_l")).alias("gram")).distinct()


def string_grams(strings: DataFrame, n_min: int, n_max: int, col: str = "s") -> DataFrame:
    """Distinct substrings ``gram`` of lengths n_min..n_max of the strings in ``col``."""
    s = F.col(col)
    with_pos = strings.select(s.alias("_s"), F.explode(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))).alias("_p"))
    with_len = with_pos.select("_s", "_p", F.explode(F.sequence(F.lit(n_min), F.lit(n_max))).alias("_n"))
    return (with_len.where(F.col("_p") + F.col("_n") - 1 <= F.length("_s"))
            .select(F.col("_s").substr(F.col("_p"), F.col("_n")).alias("gram"))
            .distinct())


def name_grams(names: DataFrame, n: int = K.NAME_OVERLAP_MIN, *, per_name: bool = False,
               order_col: str = "ord", name_col: str = "name") -> DataFrame:
    """Grams of length ``n`` of the stock-name string.

    Default: of the concatenated string (grams across name boundaries
    included, as the original does). ``per_name=True``: grams inside each name
    only.
    """
    if per_name:
        return string_grams(names.select(F.col(name_col).alias("s")).where(F.length("s") >= n), n, n)
    return concat_grams(names, n, n, order_col=order_col, name_col=name_col)


def ngrams(text: Column | str, n: int) -> Column:
    """All overlapping ``n``-character substrings of a text, in order, in ONE
    linear pass (a zero-width lookahead capture at every position).

    Positional ``substring`` on a UTF-8 string walks from its start, so
    cutting every gram with it would be quadratic in the text length.
    """
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def title_grams(posts: DataFrame, n: int, key_cols: list[str], title_col: str = "title") -> DataFrame:
    """All (key, pos, gram) of length ``n`` of each title (``pos`` 1-based)."""
    g = posts.select(*key_cols, F.posexplode(ngrams(title_col, n)).alias("_i", "gram"))
    return g.select(*key_cols, (F.col("_i") + 1).alias("pos"), "gram")


def filter_name_overlap(posts: DataFrame, grams: DataFrame, n: int = K.NAME_OVERLAP_MIN,
                        title_col: str = "title") -> DataFrame:
    """Drop posts whose title shares an ``n``-gram with the name string.

    Titles are exploded to grams and semi-joined with the gram set; the
    titles with a hit are identified by a 128-bit fingerprint (two seeded
    64-bit hashes), so only fingerprints — never the texts — are shuffled,
    and posts are anti-joined on it. (The flag depends on the title alone;
    two different titles share a fingerprint with probability ~2^-128.)
    With an empty name string nothing is dropped.
    """
    t = F.col(title_col)
    keyed = posts.withColumn("_h1", F.xxhash64(t)).withColumn("_h2", F.xxhash64(F.lit("saiflow-fp"), t))
    hits = (keyed.select("_h1", "_h2", F.explode(F.array_distinct(ngrams(t, n))).alias("gram"))
            .join(grams.select("gram"), "gram", "left_semi")
            .select("_h1", "_h2").distinct())
    return keyed.join(hits, ["_h1", "_h2"], "left_anti").drop("_h1", "_h2")


def _longest_from(rows: DataFrame, g_dict: DataFrame, lo: int, top: int) -> DataFrame:
    """``rows`` with ``len``: how many of the first characters of ``_w``, from
    ``lo`` to ``top``, make a gram of ``g_dict``; ``top - lo`` is 2^k - 1.

    What begins a match is a match, so the length is found by halving steps:
    each row meets the grams once for each of k steps. A row too short for a step's
    length meets them with what it has, as null keys would all go to one task.
    """
    known = g_dict.select(F.col("gram").alias("_g"), F.lit(True).alias("_in"))
    rows, step = rows.withColumn("len", F.lit(lo)), (top - lo + 1) // 2
    while step:
        test = F.col("len") + step
        hit = F.coalesce("_in", F.lit(False)) & (F.length("_w") >= test)
        rows = (rows.withColumn("_g", F.col("_w").substr(F.lit(1), test)).join(known, "_g", "left")
                    .withColumn("len", F.when(hit, test).otherwise(F.col("len"))).drop("_g", "_in"))
        step //= 2
    return rows


def longest_name_match(posts: DataFrame, names: DataFrame, key_cols: list[str],
                       title_col: str = "title", start_cap: int = 8) -> DataFrame:
    """Longest common substring of each title with the name string.

    Returns ``key_cols + (max_sub, max_len)``; the first longest match in the
    title wins; ``('', 0)`` when nothing matches.

    ``names(ord, name)`` define the string (names concatenated in ``ord``
    order). Each position of a title is one row with the characters that
    follow; the length of its match is searched by halving (``_longest_from``)
    among the distinct grams of the string (``concat_grams``), on the text
    itself, so nothing is left to verify. Exact at any length: the first
    search goes to 2^k - 1 >= ``start_cap``; only titles whose match reaches
    that top can have a longer one, and they alone are searched again, over
    twice as many lengths, until no title reaches the top. The loop runs at most log2(longest title) times.
    """
    base = posts.select(*key_cols, F.col(title_col).alias("_t"))
    bands = []
    todo, lo, width = base, 0, (1 << max(1, start_cap.bit_length())) - 1
    while True:
        top = lo + width
        at = todo.select(*key_cols, F.posexplode(F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{1,{top}}}))"), 1)).alias("_i", "_w"))
        found = _longest_from(at.where(F.length("_w") > lo), concat_grams(names, lo + 1, top), lo, top)
        best = found.where(F.col("len") > lo).groupBy(*key_cols).agg(
            F.max_by(F.struct("_w", "len"), F.struct("len", -F.col("_i"))).alias("b"))
        # written to the shared folder: read twice, and no cache is left behind
        best = best.select(*key_cols, F.col("b._w").substr(F.lit(1), F.col("b.len")).alias("max_sub"), F.col("b.len").alias("max_len"))
        best = staged(best, "longest-match")
        bands.append(best)
        reached = best.where(F.col("max_len") >= top).select(*key_cols)
        if reached.isEmpty():
            break
        todo = todo.join(reached, key_cols, "left_semi")
        lo, width = top, 2 * width + 1
    found = bands[0]
    for b in bands[1:]:
        found = found.unionByName(b)
    if len(bands) > 1:
        found = found.groupBy(*key_cols).agg(F.max_by(F.struct("max_sub", "max_len"), "max_len").alias("b")) \
                     .select(*key_cols, "b.max_sub", "b.max_len")
    none = base.join(found, key_cols, "left_anti").select(*key_cols, F.lit("").alias("max_sub"),
                                                          F.lit(0).alias("max_len"))
    return found.unionByName(none)


# ---- page prefixes (F15, F16) ----------------------------------------------

def pages_until_cutoff(posts: DataFrame, end_date: str, start_page: int = 1,
                       page_col: str = "page_no") -> DataFrame:
    """Pages from ``start_page`` on, while the page's oldest post is
    later than ``end_date`` 13:10; the first page that reaches the cut-off and
    every later page are left out.

    Two scalar aggregates (per-page minimum, then the first failing page)
    replace the crawler's sequential loop; no global window.
    """
    cutoff = F.to_timestamp_ntz(F.lit(f"{end_date} {K.PAGE_CUTOFF_HOUR:02d}:{K.PAGE_CUTOFF_MINUTE:02d}:00"))
    eligible = posts.where(F.col(page_col) >= start_page)
    first_fail = (eligible.groupBy(page_col).agg(F.min("dtime").alias("_oldest"))
                  .where(F.col("_oldest") <= cutoff)
                  .agg(F.min(page_col).alias("_ff")))
    bound = F.coalesce(first_fail.scalar(), F.lit(2**31 - 1))
    return eligible.where(F.col(page_col) < bound)


def pages_by_count(posts: DataFrame, start_page: int, count: int, page_col: str = "page_no") -> DataFrame:
    """F16: ``count`` consecutive pages starting at ``start_page``."""
    return posts.where(F.col(page_col).between(start_page, start_page + count - 1))
