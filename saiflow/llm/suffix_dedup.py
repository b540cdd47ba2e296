"""Removal of exact byte strings that repeat, by suffix arrays built on Spark partitions.

A window is a string of ``length`` bytes within one text. Every byte covered
by a window that also starts anywhere else (in any text, the same one
included) is removed; windows are judged on the input, and overlaps count.

1. Every text is cut by content-defined anchors (``anchors``): equal windows
   lie under equal anchor grams at equal offsets. An anchor's segment is all
   of its windows' bytes. Only hashes of grams and segments are shuffled, and
   anchors whose gram occurs once are done.
2. Under a gram with one distinct segment all windows repeat. Grams with
   several are grouped into tasks; there each eight neighbouring window
   starts share a core of ``length - 7`` bytes, which becomes one symbol with
   the few differing bytes to its left and right. The suffix array of these
   strings (``suffix_array``, linear grouping) puts equal windows side by
   side: a window repeats if its run holds two or more in total, copies of
   equal segments included.
3. A gram with more than ``group_limit`` distinct segments is not gathered in
   one task: its windows are counted under the hash of their bytes by an
   aggregate, which is exact as well.

Texts meet by their 128-bit digest, so equal texts share their marks, and no
shuffle gathers the rows of one text. Lists are per distinct text and bounded
by its length.

Defined results: a null text is empty, has no spans and keeps b""; texts
shorter than the window keep all; repeated rows count as separate texts, so
both lose all their bytes if they are as long as a window; an empty table
gives no rows; other columns are kept, but for n_bytes, kept and spans, which
are replaced (names that start with "_sd_" are the operator's own).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import AnchorFinder
from .common import byte_slices, spread, stage
from .suffix_array import repeated_starts

STEP = 8  # neighbouring window starts that share a core
BATCH_SYMBOLS = 200_000  # symbols of one suffix array


def _digest(col):
    """128-bit digest of a text, as two longs in a struct."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(17), col).alias("b"))


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of each text: gram hash, segment hash, text, first and last window start, anchor's offset from the first."""
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                        ("lo", pa.int32()), ("span", pa.int32()), ("x0", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(length, gram)
        for batch in batches:
            ta, tb = (batch.column(c).to_numpy() for c in ("a", "b"))
            for first, last, data, off in byte_slices(batch.column("text")):
                text, p, lo, hi = finder.find(data, off[:-1], off[1:])
                if not len(p):
                    continue
                raw = data.tobytes()
                key = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:i + gram]) for i in p.tolist()), np.uint64, len(p))
                seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j + length], k) for i, j, k in zip(lo.tolist(), hi.tolist(), (p - lo).tolist())),
                                  np.uint64, len(p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ta[first:last][text]), pa.array(tb[first:last][text]),
                     pa.array((lo - off[text]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((p - lo).astype(np.int32))], schema=schema)

    return (texts.select("text", F.col("digest.a").alias("a"), F.col("digest.b").alias("b"))
            .mapInArrow(find, "key long, seg long, a long, b long, lo int, span int, x0 int"))


class _Batch:
    """Strings of several grams that go into one suffix array."""

    def __init__(self, length: int):
        self.length = length
        self.symbols: list[int] = []
        self.weights: list[tuple[int, int]] = []
        self.owners: dict[int, list[tuple[int, int]]] = {}  # position -> (segment, window start)
        self.cores = 0
        self.marks: dict[int, set[int]] = defaultdict(set)

    def add_gram(self, segments: list[tuple[int, bytes, int, int, int]]) -> None:
        """The distinct segments of a gram: (number, bytes, anchor's offset, span, copies)."""
        cores: dict[bytes, dict] = {}
        core_len = self.length - STEP + 1
        for number, raw, x0, span, copies in segments:
            least = x0 - span  # offsets of the anchor in the windows: least..x0
            for base in range(least - least % STEP, x0 + 1, STEP):
                at = x0 - base
                high, low = min(base + STEP - 1, x0), max(base, least)
                key = (raw[x0 - high:at], raw[at + core_len:x0 - low + self.length])
                sides = cores.setdefault((base, raw[at:at + core_len]), {})
                entry = sides.get(key)
                if entry is None:
                    sides[key] = [copies, low - base, [(number, x0 - base)]]
                else:
                    entry[0] += copies
                    entry[2].append((number, x0 - base))
        for sides in cores.values():
            if len(sides) == 1:
                ((left, _), (copies, low, owners)), = sides.items()
                if copies >= 2:
                    for number, at in owners:
                        self.marks[number].update(range(at - len(left), at - low + 1))
                continue
            self.cores += 1
            for (left, right), (copies, low, owners) in sides.items():
                start = len(self.symbols)
                self.symbols.extend(c + 1 for c in left)
                self.symbols.append(256 + self.cores)
                self.symbols.extend(c + 1 for c in right)
                self.symbols.append(0)
                for k in range(len(left) + 1 - low):  # the window that starts k symbols into the string
                    self.weights.append((start + k, copies))
                    self.owners[start + k] = [(number, at - len(left) + k) for number, at in owners]

    def resolve(self) -> dict[int, set[int]]:
        if self.symbols:
            weights = np.zeros(len(self.symbols), np.int64)
            at, copies = np.array(self.weights, np.int64).T
            weights[at] = copies
            for p in repeated_starts(np.array(self.symbols, np.int64), weights, STEP).tolist():
                for number, start in self.owners[p]:
                    self.marks[number].add(start)
        return self.marks


def _intervals(starts: set[int]) -> list[tuple[int, int]]:
    """Sorted numbers as closed intervals."""
    s = np.array(sorted(starts), np.int32)
    cut = np.flatnonzero(np.diff(s) > 1)
    return list(zip(s[np.append(0, cut + 1)].tolist(), s[np.append(cut, len(s) - 1)].tolist()))


def _resolve_segments(segments: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeated window starts of segments whose grams have several: key, seg, marks array<struct<from, to>>."""
    mark = pa.struct([("from", pa.int32()), ("to", pa.int32())])
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("marks", pa.list_(mark))])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, names, own, last = _Batch(length), [], [], None

        def out() -> pa.RecordBatch:
            rows = [(*names[number], [{"from": a, "to": b} for a, b in _intervals(starts)]) for number, starts in batch.resolve().items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, schema)], schema=schema)

        for b in batches:
            for key, seg, copies, raw, x0, span in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "copies", "raw", "x0", "span"))):
                if key != last and own:
                    batch.add_gram(own)
                    own = []
                    if len(batch.symbols) >= BATCH_SYMBOLS:
                        yield out()
                        batch, names = _Batch(length), []
                last = key
                own.append((len(names), raw, x0, span, copies))
                names.append((key, seg))
        if own:
            batch.add_gram(own)
        yield out()

    return segments.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(resolve, "key long, seg long, marks array<struct<from:int,to:int>>")


def _count_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many segments for a task: windows counted by the hash of their bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("copies", pa.int64()), ("start", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            rows = []
            for key, seg, copies, raw, span, x0 in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "copies", "raw", "span", "x0"))):
                for s in range(span + 1):
                    h = xxhash.xxh3_128_intdigest(raw[s:s + length], x0 - s)
                    rows.append((key, seg, copies, s, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)

    rows = segments.mapInArrow(windows, "key long, seg long, copies long, start int, a long, b long")
    twice = rows.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n >= 2").drop("n")
    found = rows.join(twice, ["a", "b"], "left_semi")
    # a segment has no more window starts than an anchor spans
    return found.groupBy("key", "seg").agg(F.collect_list(F.struct(F.col("start").alias("from"), F.col("start").alias("to"))).alias("marks"))


def repeated_windows(spark: SparkSession, texts: DataFrame, length: int, gram: int, group_limit: int) -> DataFrame:
    """Starts of repeated windows of each distinct text (columns text, digest): a, b (its digest), marks
    array<struct<lo, marks array<struct<from, to>>>>, the inner ones counted from lo."""
    occurrences = _occurrences(texts, length, gram)
    common = occurrences.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # grouped without the gram, which the segment implies: the join keeps no grouping, so a hot gram can be split
    places = (occurrences.join(common, "key").groupBy("seg", "a", "b", "lo", "span", "x0").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    places = stage(spark, places, "repeat-places")
    segs = places.groupBy("key", "seg").agg(F.sum("n").alias("copies"), F.min(F.struct("a", "b", "lo", "span", "x0")).alias("at"))
    grams = segs.groupBy("key").agg(F.count("*").alias("segs"))
    segs = stage(spark, segs.join(grams, "key").filter("segs > 1").select("key", "seg", "copies", "segs", "at.*"), "repeat-segments")

    # the bytes of each distinct segment, from one text that holds it
    wanted = segs.groupBy("a", "b").agg(F.collect_list(F.struct("key", "seg", "copies", "segs", "lo", "span", "x0")).alias("own"))
    held = texts.join(wanted, (F.col("digest.a") == F.col("a")) & (F.col("digest.b") == F.col("b")))
    cut = held.select("text", F.inline("own")).select(
        "key", "seg", "copies", "segs", "span", "x0", F.substring(F.col("text"), F.col("lo") + 1, F.col("span") + length).alias("raw"))
    # equal texts each give the same bytes
    cut = stage(spark, cut.groupBy("key", "seg").agg(*(F.first(c).alias(c) for c in ("copies", "segs", "span", "x0", "raw"))), "repeat-bytes")

    few, many = cut.filter(F.col("segs") <= group_limit), cut.filter(F.col("segs") > group_limit)
    found = _resolve_segments(few, length, spread(spark)).unionByName(_count_windows(many, length))
    found = stage(spark, found, "repeat-marks")
    several = segs.select("key").distinct()
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("span").alias("to")))
    alone = places.join(several, "key", "left_anti").select("a", "b", "lo", whole.alias("marks"))
    marked = places.join(found, ["key", "seg"]).select("a", "b", "lo", "marks")
    # one row per distinct text; a text's marks are bounded by its length
    return alone.unionByName(marked).groupBy("a", "b").agg(F.collect_list(F.struct("lo", "marks")).alias("marks"))


def cut_text(raw: bytes, marks, length: int, whole_chars: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes that stay, maximal removed runs as [start, end)). ``whole_chars`` keeps a character
    whose bytes are not all removed."""
    spans: list[list[int]] = []
    for a, b in sorted((at["lo"] + m["from"], at["lo"] + m["to"]) for at in marks for m in at["marks"]):
        a, b = a, b + length
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    if whole_chars:
        for s in spans:
            while s[0] < s[1] and raw[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[1] > s[0] and s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
        spans = [s for s in spans if s[0] < s[1]]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), [(a, b) for a, b in spans]


def remove_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text", length: int = 200, gram: int = 64,
                   group_limit: int = 20_000, whole_chars: bool = False) -> DataFrame:
    """``docs`` without its text, with n_bytes, spans (array<struct<start, end>> of removed bytes) and kept (binary)."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.withColumn("_sd_text", body).drop(text_col).withColumn("_sd_digest", _digest(F.col("_sd_text")))
    texts = rows.select(F.col("_sd_text").alias("text"), F.col("_sd_digest").alias("digest"))
    marks = repeated_windows(spark, texts, length, gram, group_limit).toDF("_sd_a", "_sd_b", "_sd_marks")
    marked = rows.join(marks, (F.col("_sd_digest.a") == F.col("_sd_a")) & (F.col("_sd_digest.b") == F.col("_sd_b")), "left")

    @F.pandas_udf("struct<kept:binary,spans:array<struct<start:int,end:int>>>")
    def cut(text: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = [(t, []) if m is None or not len(m) else cut_text(t, m, length, whole_chars) for t, m in zip(text, marks)]
        return pd.DataFrame({"kept": [k for k, _ in out], "spans": [[{"start": a, "end": b} for a, b in s] for _, s in out]})

    return (marked.withColumn("_sd_cut", cut("_sd_text", "_sd_marks")).withColumn("n_bytes", F.octet_length("_sd_text").cast("long"))
            .withColumn("kept", F.col("_sd_cut.kept")).withColumn("spans", F.col("_sd_cut.spans"))
            .drop("_sd_text", "_sd_cut", "_sd_digest", "_sd_a", "_sd_b", "_sd_marks"))
