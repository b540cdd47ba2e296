"""I-Match fingerprints: hashes of the distinct terms within a band of inverse document frequency,
over several randomised subsets of the lexicon.

The lexicon is the terms whose document frequency lies in the band, each known
by its 64-bit hash. Slot (level, k) of a fingerprint hashes the sorted terms of a
text (each as the first 32 bits of its hash) that fall into a random subset
holding one in 2^level of the lexicon; k numbers independent subsets. A full
lexicon tells equal texts, a thin one still agrees after an edit. A text with
fewer than ``least_terms`` terms of the lexicon uses all its terms.

The likeness of two fingerprints is, at the level where they agree most, the
share of equal slots among those filled in either (or among ``least_slots``, if fewer are).

How little moves: texts are exchanged once, in runs of ascending ids, where
each meets the next one and its edited text is made. The distinct terms of a
text and of its edited text go out together, as terms of both or of one. The
``COMMON`` commonest terms of the lexicon, which make up most terms that are in it, and the few terms
above the band are known to all tasks; only the other terms are shuffled to
meet the rest of the lexicon, and go back to the run of their text. There a document's terms become arrays of 32-bit
numbers, from which both fingerprints follow at once. Everything is built-in functions.

Defined results: a null or empty text has no terms and the fingerprint of
empty slots, which is fully like itself; repeated rows and equal texts have
equal fingerprints; an empty table gives no rows; rows without id come first in the order of
documents, by the hashes of their texts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import native_perhaps, stage_alone

LEVELS, SUBSETS = 10, 8
#: Terms of the lexicon that every task holds (8 bytes each, some 50 MB with the table's own room).
COMMON = 1 << 20
#: Texts whose terms a task gathers in memory before it sorts instead (some 10 kB a text of 400 terms; a task has no more than its share of the texts).
HELD = 1 << 13
ROOM = (1 << 63) - 1
OWN, EDITED, BOTH = 1, 2, 3


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(terms(text), lambda w: F.xxhash64(w)))


def lexicon(spark: SparkSession, docs: DataFrame, text_col: str, least_df: int, least_idf: float) -> tuple[DataFrame, DataFrame]:
    """Hashes h and df of the terms in the band ``least_df`` <= df and ln(documents / df) >= ``least_idf`` (or df = ``least_df``,
    in small tables), and of those above it. A document has few terms above the band on average, at most
    e^least_idf times as many exist: their number does not grow with the documents."""
    df = docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    inside = (F.col("df") == least_df) | (F.log(F.lit(docs.count()) / F.col("df")) >= least_idf)
    found = stage_alone(spark, df.select("h", "df", inside.alias("inside")), "imatch-lexicon")
    return found.filter("inside").select("h", "df"), found.filter("not inside").select("h")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(short: Column) -> Column:
    """Of the sorted 32-bit terms of a text. Slots as array<int>, level by level: 0 for an empty subset, else 1 + 24 bits of its hash."""

    def slot(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.lit(0)).otherwise(F.xxhash64(hashes).bitwiseAND(F.lit(0xFFFFFF)).cast("int") + 1)

    def subset(k: int) -> Column:
        """Each level is looked for in the one before it."""
        hashes = F.transform(short, lambda w: F.xxhash64(w, F.lit(k)))
        start = F.struct(hashes.alias("h"), F.array().cast("array<int>").alias("s"))
        return F.aggregate(F.array(*(F.lit(1 << n).cast("long") for n in range(LEVELS))), start, lambda level, bit: F.struct(
            F.filter(level["h"], lambda h: h.bitwiseAND(bit) == 0).alias("h"), F.concat(level["s"], F.array(slot(level["h"]))).alias("s")), lambda level: level["s"])

    by_subset = F.flatten(F.array(*(subset(k) for k in range(SUBSETS))))
    return bound(by_subset, lambda s: F.transform(F.sequence(F.lit(0), F.lit(LEVELS * SUBSETS - 1)), lambda i: F.get(
        s, (i % SUBSETS) * LEVELS + F.floor(i / SUBSETS).cast("int"))))


def as_text(slots: Column) -> Column:
    """Seven hexadecimal digits a slot, two slots at a time."""
    def pair(i: Column) -> Column:
        digits = F.shiftleft(F.get(slots, i).cast("long"), 28).bitwiseOR(F.get(slots, i + 1).cast("long"))
        return F.substring(F.hex(digits.bitwiseOR(F.lit(1 << 56))), 2, 14)

    return F.lower(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(LEVELS * SUBSETS - 2), F.lit(2)), pair)))


def likeness(a: Column, b: Column, least_slots: int = 4) -> Column:
    # each pair of slots is compared once: 0 if both are empty, 16 if they differ, 17 if they are equal
    agreed = F.zip_with(a, b, lambda x, y: F.when(x != y, 16).when(x != 0, 17).otherwise(0))

    def level(all_: Column, n: Column) -> Column:
        s = F.aggregate(F.slice(all_, n * SUBSETS + 1, SUBSETS), F.lit(0), lambda s, x: s + x)
        return bound(s, lambda s: s.bitwiseAND(F.lit(15)) / F.greatest(F.shiftright(s, 4), F.lit(least_slots)))

    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return F.when(a == b, F.lit(1.0)).otherwise(F.array_max(bound(agreed, lambda all_: F.transform(levels, lambda n: level(all_, n)))))


def with_next(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str, columns: list[str], groups: int) -> DataFrame:
    """Add next_<column> of the next of ``rows`` (which have a number ``row``) in ascending id order; after the last comes the first.
    Add _run, too: the run of neighbours a row lies in, by which the result is partitioned.

    Rows are dealt to about ``groups`` runs of neighbours: those with an id by
    approximate quantiles of the ids, which one far id does not move, those
    without by equal ranges of their texts' hashes. The first rows of each run
    are also put at the end of the run before, so one exchange is enough. What
    comes to the driver is a few numbers a run.
    """
    mark = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(ROOM))
    no_id = F.col(id_col).isNull()
    ends = rows.agg(F.count_if(no_id).alias("none"), F.count("*").alias("n"),
                    F.percentile_approx(id_col, [k / groups for k in range(1, groups)] or [0.5], 10 * groups).alias("bounds")).first()
    if not ends.n:
        return rows.select("*", F.lit(0).alias("_run"), *(F.col(c).alias(f"next_{c}") for c in columns))
    first_runs = -(-groups * ends.none // ends.n)
    width = min(ROOM, -(-(ROOM + 1) // max(1, first_runs)))
    bounds = sorted(set(ends.bounds or []))
    later = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b < F.col(id_col))) if bounds else F.lit(0)
    run = F.when(no_id, F.floor(F.col("_mark").cast("decimal(20,0)") / F.lit(width).cast("decimal(20,0)")).cast("int")).otherwise(later + first_runs)
    keyed = rows.withColumn("_mark", mark).withColumn("_run", run).withColumn("_order", F.when(no_id, F.col("_mark")).otherwise(F.col(id_col).cast("long")))
    heads = keyed.groupBy("_run").agg(F.min(F.struct("_order", "_mark")).alias("head")).collect()
    runs = sorted(r._run for r in heads)
    before = {r: runs[k - 1] for k, r in enumerate(runs)}  # of the first run: the last
    first = spark.createDataFrame([(r._run, r.head._order, r.head._mark, before[r._run]) for r in heads], "_run int, _order long, _mark long, _to int")
    copies = keyed.join(F.broadcast(first), ["_run", "_order", "_mark"]).withColumn("_run", F.col("_to")).select(*keyed.columns)
    joined = keyed.withColumn("_extra", F.lit(False)).unionByName(copies.withColumn("_extra", F.lit(True)))
    order = Window.partitionBy("_run").orderBy("_extra", "_order", "_mark", "row")
    for c in columns:
        joined = joined.withColumn(f"next_{c}", F.lead(c).over(order))
    return joined.filter(~F.col("_extra")).select(*rows.columns, "_run", *(f"next_{c}" for c in columns))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many first ones (or all) of ``following``."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def _short(h: Column) -> Column:
    """The first 32 bits of a hash."""
    return F.shiftright(h, 32).cast("int")


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_df: int = 2, least_idf: float = 3.0,
                 least_terms: int = 3, groups: int | None = None, common_terms: int = COMMON, with_text: bool = True) -> DataFrame:
    """Per document: n_chars, edited_text (``with_text``) and its SHA-256, fingerprint, that of the edited text, and the likeness of its own to that
    and to the next document's.

    Rows are numbered as they are read, more than once: ``docs`` must give the same rows again, as tables in files do.
    """
    inside, above = lexicon(spark, docs, text_col, least_df, least_idf)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    groups = groups or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = with_next(spark, rows, "doc_id", "text", ["text", "row"], min(1024, groups))
    both = both.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    key = ["_run", "row"]
    about = ["doc_id", "next_row", "n_chars", "edited_sha256"]

    own, new = F.col("_own"), F.col("_new")
    # no run is null; a join below would say so of one of two uses, which then could not share the texts' exchange
    each = both.filter("_run is not null").select(*key, "doc_id", "next_row", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       term_hashes(F.col("text")).alias("_own"), term_hashes(F.col("edited")).alias("_new"))
    each = each.select(*key, *about, F.array_intersect(own, new).alias("_both"), F.array_except(own, new).alias("_own"), F.array_except(new, own).alias("_new"))
    each = each.select(*key, *about, F.size("_both").alias("_n"), (F.size("_both") + F.size("_own")).alias("_m"), F.posexplode_outer(F.concat("_both", "_own", "_new")).alias("_at", "h"))
    each = each.withColumn("of", F.when(F.col("_at") < F.col("_n"), BOTH).when(F.col("_at") < F.col("_m"), OWN).otherwise(EDITED)).drop("_at", "_n", "_m")
    common = F.broadcast(inside.orderBy(F.desc("df"), "h").limit(common_terms).select("h"))
    rest = inside.join(common, "h", "left_anti").select("h")

    def lists(prefix: str) -> list[Column]:
        return [F.collect_list(F.when(F.col("of") == of, _short(F.col("h")))).alias(f"{prefix}{of}") for of in (OWN, EDITED, BOTH)]

    # all terms of a text lie where the text does: nothing of ``known`` is exchanged, and the other terms come to it
    known = each.join(common.withColumn("_known", F.lit(True)), "h", "left").withColumn("of", F.when(F.col("_known"), F.col("of")))
    known = known.groupBy(*key).agg(*(F.any_value(c).alias(c) for c in about), *lists("t"))
    # by the same columns as ``known``, so that the texts' exchange serves both
    rare = each.select(*key, "doc_id", "next_row", "h", "of").filter("h is not null").join(common, "h", "left_anti").join(F.broadcast(above), "h", "left_anti").join(rest, "h", "left_semi")
    rare = rare.repartition("_run").groupBy(*key, "doc_id", "next_row").agg(*lists("r")).drop("doc_id", "next_row")
    found = known.join(rare, key, "left")

    def gathered(of: int) -> Column:
        parts = (c for part in (BOTH, of) for c in (F.col(f"t{part}"), F.coalesce(f"r{part}", F.array().cast("array<int>"))))
        return F.array_sort(F.concat(*parts))

    columns = ["row", *about, "few_text", "few_edited", "slots", "edited_slots"]
    found = found.select("row", *about, gathered(OWN).alias("of_text"), gathered(EDITED).alias("of_edited"))
    few = lambda c: F.size(c) < least_terms
    found = found.select("row", *about, few("of_text").alias("few_text"), few("of_edited").alias("few_edited"), fingerprint(F.col("of_text")).alias("slots"),
                         fingerprint(F.col("of_edited")).alias("edited_slots"))
    found = stage_alone(spark, found, "imatch-slots", {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HELD),
                                                          "spark.sql.requireAllClusterKeysForCoPartition": "false"})

    # texts with too few terms of the lexicon: all their terms, from these texts and the next ones alone, which are read where they lie
    wanting = F.col("few_text") | F.col("few_edited")
    too_few = found.filter(wanting)
    ids = too_few.select("row").union(too_few.select("next_row")).distinct()
    texts = native_perhaps(rows.select("row", "text"), ids, ["row"]).join(ids, "row")
    whole = too_few.join(texts, "row").join(texts.select(F.col("row").alias("next_row"), F.col("text").alias("next_text")), "next_row")
    whole = whole.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    every = lambda t: F.array_sort(F.transform(term_hashes(t), _short))
    whole = whole.withColumns({"_text": every(F.col("text")), "_edited": every(F.col("edited"))})
    for few_terms, of, all_terms in (("few_text", "slots", "_text"), ("few_edited", "edited_slots", "_edited")):
        whole = whole.withColumn(of, F.when(F.col(few_terms), fingerprint(F.col(all_terms))).otherwise(F.col(of)))
    whole = stage_alone(spark, whole.select(*columns), "imatch-whole")
    slots = found.filter(~wanting).unionByName(whole).drop("few_text", "few_edited")
    following = slots.select(F.col("row").alias("next_row"), F.col("slots").alias("next_slots"))
    out = slots.join(following, "next_row")
    if with_text:  # the texts once more
        out = out.join(both.select("row", F.col("edited").alias("edited_text")), "row")
    return out.select("doc_id", "n_chars", *["edited_text"] * with_text, "edited_sha256", as_text(F.col("slots")).alias("fingerprint"), as_text(F.col("edited_slots")).alias("edited_fingerprint"),
                      likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))
