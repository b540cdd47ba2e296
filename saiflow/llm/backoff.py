"""Stupid-backoff language-model scores of documents, from counts of the whole corpus.

The score of a word after the ``order`` - 1 words before it is c(gram) / c(gram without
its last word) if the gram was counted at least ``min_count`` times, else
``alpha`` times the score after one word less; without any word before it, it is
c(w) / N. Words at a text's beginning have fewer words before them, without a
factor. A document's score is the sum of the logarithms.

Words are the 64-bit hashes of their lower-case forms, and a gram is its words. The
``frequent`` commonest words at most are known to all tasks, with their counts, and
travel as small numbers; the other words travel as hashes (63 bits of them, the
sign marks them). A gram is compared by all its words.

1. Words are counted in a table, combined within tasks before their shuffle.
2. Each word goes, with the words before it and its document, to the task of its
   last two words. All grams of one ending meet there, so the counts of all orders but the
   first follow at once, and each row finds the longest gram that is counted often enough.
3. What a row divides by, the count of that gram without its last word, was counted in
   another task: it is asked there, as are the counts of words that not all tasks know.
4. Documents' sums meet.

These three exchanges carry runs of rows as columns of bytes, compressed (``_pack``):
small numbers and neighbouring documents take little room, about six bytes a word
in the largest. Everything grows with the corpus in Spark; the words that all tasks know are a fixed number.
Rows of one ending (two words) meet in one task. A task keeps its runs compressed and unpacks
about ``held`` rows of them at a time, by a further hash of what meets (``_buckets``).

Defined results: rows of one id count as one document, and rows without id as
one with a null id; null texts and texts without words have no
tokens, the sum 0 and a null mean; repeated rows count twice in the corpus; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stage

#: Stands before a text's first word.
START = 0
#: Words that a task takes at a time.
CHUNK = 1_000_000
#: Rows that a task unpacks at a time (those of one ending or gram at least).
HELD = 1 << 19
#: Words that every task holds (24 bytes each).
FREQUENT = 1 << 20
TOKENS, COUNTS, ASKED, SUMS = range(4)
PACKED = "part int, kind int, n int, packed binary"
_RARE = np.int64(-1 << 63)
_K = np.uint64(0x9E3779B97F4A7C15)


def word_classes(text: str | None, class_bits: int = 64) -> np.ndarray:
    """The first bits of the hashes of a text's words."""
    w = (text or "").lower().split()
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), np.uint64, len(w))
    return (h >> np.uint64(64 - class_bits)).astype(np.int64)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Of runs of rows, whose last column is their text: hashes of the distinct words, each word's place among them,
    the rows' numbers of words, and the rows' first column."""
    numbers, places, lengths, ids, size = _Numbers(), [], [], [], 0

    def taken():  # nothing of a chunk stays here while it is worked on
        nonlocal numbers, places, lengths, ids, size
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in numbers), np.uint64, len(numbers)).view(np.int64)
        chunk = hashes, np.concatenate(places), np.array(lengths, np.int64), ids
        numbers, places, lengths, ids, size = _Numbers(), [], [], [], 0
        return chunk

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(batch.num_columns - 1)):
            w = (text.as_py() or "").lower().split()
            places.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
            lengths.append(len(w))
            ids.append(doc)
            size += len(w) + 1
            if size > CHUNK:
                yield taken()
    if ids:
        yield taken()


def count_words(texts: DataFrame) -> DataFrame:
    """w, count of all words. ``texts``: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, places, _, _ in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(places, minlength=len(hashes)))], ["w", "n"])

    return texts.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("count"))


def common_words(counts: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most ``frequent`` words, all those above a count: hashes, ascending, their places by descending count, and the counts by place."""
    bin_ = F.floor(F.log2("count") * 16)
    left, least = frequent, None
    for r in counts.groupBy(bin_.alias("bin")).count().orderBy(F.desc("bin")).collect():  # at most 1,024 rows
        left -= r["count"]
        if left < 0:
            break
        least = r.bin
    if least is None:
        return (np.zeros(0, np.int64),) * 3
    found = counts.filter(bin_ >= least).select("w", "count").toArrow()
    w, n = (found.column(k).to_numpy() for k in range(2))
    by_count = np.lexsort((w, -n))
    w, n = w[by_count], n[by_count]
    place = np.argsort(w)
    return w[place], place, n


def _numbered(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """1.. for the ``common`` words, the commonest first, else the hash with its sign set."""
    known, place, _ = common
    if not len(known):
        return hashes | _RARE
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, place[at] + 1, hashes | _RARE)


def _mixed(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """A part for each row, by all ``columns``."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = ((mixed ^ (mixed >> np.uint64(29))) + column.view(np.uint64) + np.uint64(1)) * _K
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _pack(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows by part, in their order: one packed row a part. Columns are numbers of 8 bytes, first by the differences of
    the first one, then by byte: those of small numbers are nearly all 0."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    ends, blobs = [*first[1:], len(order)], []
    for a, z in zip(first, ends):
        own = [c[order[a:z]] for c in columns]
        own[0] = np.diff(own[0], prepend=np.int64(0))
        planes = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in own)
        blobs.append(pa.compress(planes, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), kind), pa.int32()),
                                       pa.array(np.subtract(ends, first), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "n", "packed"])


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """The packed runs of each kind, with their numbers of rows."""
    held = defaultdict(list)
    for batch in batches:
        for kind, n, packed in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            held[kind].append((n, packed))
    return held


def _buckets(runs: list[tuple[int, bytes]], held: int) -> int:
    """In how many buckets a task takes its rows: about ``held`` at a time."""
    return max(1, -(-sum(n for n, _ in runs) // held))


def _unpack(runs: list[tuple[int, bytes]], width: int, chosen: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> list[np.ndarray]:
    """The ``width`` columns of packed runs, of their ``chosen`` rows."""
    found: list[list] = [[] for _ in range(width)]
    for n, packed in runs:
        planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n * width, codec="zstd"), np.uint8)
        columns = [np.ascontiguousarray(p.reshape(8, n).T).view(np.int64).ravel() for p in np.split(planes, width)]
        columns[0] = np.cumsum(columns[0])
        if chosen is not None:
            own = np.flatnonzero(chosen(columns))
            columns = [c[own] for c in columns]
        for column, parts in zip(columns, found):
            parts.append(column)

    def whole(parts: list[np.ndarray]) -> np.ndarray:
        column = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts.clear()
        return column

    return [whole(parts) for parts in found]


def _ending(doc: np.ndarray, words: list[np.ndarray], parts: int) -> np.ndarray:
    """A part for each row, by its last two words; a text's first word is met by no other."""
    return np.where(words[-2] == START, _mixed([doc], parts), _mixed(words[-2:], parts))


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the rows' groups of equal values, from 0."""
    group = pd.factorize(columns[0])[0]
    for column in columns[1:]:
        other = pd.factorize(column)[0]
        group = pd.factorize(group * (other.max(initial=0) + 1) + other)[0]
    return group


def _first(group: np.ndarray) -> np.ndarray:
    """The first row of each group."""
    first = np.zeros(group.max(initial=-1) + 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    return first


def _sums(doc: np.ndarray, no_id: np.ndarray, n: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """One row a document, ascending: doc, no_id, n, value."""
    group = _groups(doc, no_id)
    first = _first(group)
    first_order = np.argsort(doc[first], kind="stable")
    n, value = (np.bincount(group, x, len(first))[first_order] for x in (n, value))
    return [doc[first][first_order], no_id[first][first_order], n.astype(np.int64), value]


def _pack_sums(doc: np.ndarray, no_id: np.ndarray, n: np.ndarray, value: np.ndarray, parts: int) -> pa.RecordBatch:
    doc, no_id, n, value = _sums(doc, no_id, n, value)
    return _pack(SUMS, _mixed([doc, no_id], parts), [doc, no_id, n, value.view(np.int64)])


def document_grams(docs: DataFrame, order: int, common, parts: int) -> DataFrame:
    """Packed rows doc, no_id, w1..w<order> of each word, with START before a text's first; a document without words
    has one row with START alone. ``docs``: doc_id, text."""

    def grams(hashes: np.ndarray, places: np.ndarray, lengths: np.ndarray, ids: list) -> pa.RecordBatch:
        ids = pa.array([x.as_py() for x in ids], pa.int64())
        no_id, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        at = np.arange(len(row), dtype=np.int32)
        at -= np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        last = _numbered(hashes, common.value)[places] if len(places) else np.zeros(0, np.int64)
        words = [last]
        for k in range(1, order):
            word = np.roll(last, k)
            word[at < k] = START
            words.insert(0, word)
        empty = np.flatnonzero(lengths == 0).astype(np.int32)
        if len(empty):
            row = np.append(row, empty)
            words = [np.append(w, np.full(len(empty), START)) for w in words]
        del at, last
        doc = ids[row]
        return _pack(TOKENS, _ending(doc, words, parts), [doc, no_id[row], *words])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield grams(*chunk)

    return docs.mapInArrow(explode, PACKED)


def _score_endings(rows: DataFrame, order: int, min_count: int, alpha: float, total: int, common, parts: int, held: int = HELD) -> DataFrame:
    """Of all grams of some endings: packed sums of the documents, counts of grams, and counts that are asked."""

    def bucket(doc: np.ndarray, no_id: np.ndarray, words: list[np.ndarray], sums: list) -> Iterator[pa.RecordBatch]:
        real = sum((w != START).astype(np.int64) for w in words)
        value, longest = np.zeros(len(doc)), np.minimum(real, 1)
        group = _groups(words[-1])
        for k in range(2, order + 1):
            group = _groups(group, words[-k])
            n = np.bincount(group)
            seen = (real >= k) & (n[group] >= min_count)
            longest[seen] = k
            value[seen] = np.log(n[group][seen])
            if k < order:
                first = _first(group)
                first = first[seen[first]]
                key = [w[first] for w in ([np.zeros(len(doc), np.int64)] * (order - 1 - k) + words[-k:])]
                yield _pack(COUNTS, _mixed(key, parts), [*key, n[group][first]])
        del group, n, seen
        value += (real - longest) * np.log(alpha)
        value[longest == 1] -= np.log(max(total, 1))
        # a word's own count, or that of the words before it
        asked = [np.zeros(len(doc), np.int64) for _ in range(order - 1)]
        asked[-1] = np.where(longest == 1, words[-1], 0)
        for k in range(2, order + 1):
            for j in range(1, k):
                asked[-j] = np.where(longest == k, words[-1 - j], asked[-j])
        sign = np.where(longest == 1, 1, -1)
        alone = (longest == 1) | (longest == 2)
        known = alone & (asked[-1] > 0)
        value[known] += sign[known] * np.log(common.value[2][asked[-1][known] - 1])
        ask = (longest > 0) & ~known
        key = [a[ask] for a in asked]
        yield _pack(ASKED, _mixed(key, parts), [doc[ask], no_id[ask], sign[ask], *key])
        sums.append(_sums(doc, no_id, (real > 0).astype(np.int64), value))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, sums = _held(batches)[TOKENS], []
        buckets = _buckets(runs, held)
        for b in range(buckets):
            doc, no_id, *words = _unpack(runs, order + 2, lambda c: _ending(c[0], c[2:], parts * buckets) // parts == b)
            if len(doc):
                yield from bucket(doc, no_id, words, sums)
        if sums:
            yield _pack_sums(*map(np.concatenate, zip(*sums)), parts)

    return rows.mapInArrow(score, PACKED)


def _rare_counts(counts: DataFrame, order: int, common, parts: int) -> DataFrame:
    """Packed counts of the words that not all tasks know."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = _numbered(batch.column(0).to_numpy(), common.value), batch.column(1).to_numpy()
            key = [np.zeros(int((w < 0).sum()), np.int64)] * (order - 2) + [w[w < 0]]
            yield _pack(COUNTS, _mixed(key, parts), [*key, n[w < 0]])

    return counts.select("w", "count").mapInArrow(rare, PACKED)


def _answer(rows: DataFrame, order: int, parts: int, held: int = HELD) -> DataFrame:
    """Packed sums of documents, with the counts that were asked."""

    def bucket(counts: list[np.ndarray], asks: list[np.ndarray]) -> list[np.ndarray]:
        *keys, count = counts
        doc, no_id, sign, *asked = asks
        group = _groups(*(np.concatenate(k) for k in zip(keys, asked)))
        counted = np.zeros(group.max(initial=-1) + 1, np.int64)
        counted[group[:len(count)]] = count
        value = sign * np.log(counted[group[len(count):]])
        return _sums(doc, no_id, np.zeros(len(doc), np.int64), value)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _held(batches)
        buckets = _buckets(runs[COUNTS] + runs[ASKED], held)
        docs, none, n, value = _unpack(runs[SUMS], 4)
        sums = [[docs, none, n, value.view(np.float64)]]
        for b in range(buckets):
            mine = lambda key: _mixed(key, parts * buckets) // parts == b  # noqa: B023, E731
            sums.append(bucket(_unpack(runs[COUNTS], order, lambda c: mine(c[:-1])), _unpack(runs[ASKED], order + 2, lambda c: mine(c[3:]))))
        doc, no_id, n, value = map(np.concatenate, zip(*sums))
        if len(doc):
            yield _pack_sums(doc, no_id, n, value, parts)

    return rows.mapInArrow(answer, PACKED)


def _total(rows: DataFrame, parts: int, held: int = HELD) -> DataFrame:
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _held(batches)[SUMS]
        buckets = _buckets(runs, held)
        for b in range(buckets):
            doc, no_id, n, value = _unpack(runs, 4, lambda c: _mixed(c[:2], parts * buckets) // parts == b)
            doc, no_id, n, value = _sums(doc, no_id, n, value.view(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=no_id == 1), pa.array(n), pa.array(value)], ["doc_id", "n_tokens", "log_score"])

    return rows.mapInArrow(total, "doc_id long, n_tokens long, log_score double")


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, min_count: int = 2,
          frequent: int = FREQUENT, order: int = 2, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms), mean_log_score of each document."""
    if order < 2 or min_count < 1:
        raise ValueError("order must be at least 2 and min_count at least 1")
    parts = spread(spark)
    counts = stage(spark, count_words(docs.select(F.col(text_col).alias("text"))), "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = spark.sparkContext.broadcast(common_words(counts, frequent))
    rows = document_grams(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), order, common, parts)
    scored = _score_endings(rows.repartitionById(parts, "part"), order, min_count, alpha, total, common, parts, held)
    asked = scored.unionByName(_rare_counts(counts, order, common, parts))
    sums = _answer(asked.repartitionById(parts, "part"), order, parts, held)
    sums = _total(sums.repartitionById(parts, "part"), parts, held)
    return sums.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
