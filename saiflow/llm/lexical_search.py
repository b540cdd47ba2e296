"""Ranked lexical search: the best documents of each item of a query table, without an index of the documents.

Items come in blocks of bounded size. The terms of a block's items make one
Aho-Corasick automaton, in which every term stands between two guard bytes.
Documents are scanned as bytes whose separators are that guard byte, so the
automaton reports whole terms only, and reports each occurrence: term
frequencies come straight from the text. Its outputs are term numbers, which
map to the block's items.

Each block is two scans over all documents. The first counts documents, their
terms, and the documents that hold each term of the block; the second scores.
A task keeps the ``top`` best of each item of the block, whatever it reads;
these meet in two rounds, the first of which deals an item's candidates among
many tasks. The driver holds the terms of one block at a time and their
document counts, never rows of documents.

Terms are runs of signs other than ASCII separators, with A-Z in lower case.
Weights are taken in doubles and rounded down, all else is 64-bit integers.

Defined results: a null text, or one of separators alone, has no terms and is
neither counted nor found; repeated rows are documents of their own, as are
items; an item without terms, or whose terms no document holds, has no rows; equal
scores are ranked by ascending identifier, those without one last; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, spread, stage

GUARD = 0x20
#: Byte to byte: separators to the guard, A-Z to a-z. Bytes of other signs stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else GUARD for b in range(256))
NO_ID = np.iinfo(np.int64).max


def item_terms(text: str | None) -> list[bytes]:
    """The distinct terms of a text."""
    return sorted(set((text or "").encode().translate(FOLD).split()))


class Lexicon:
    """The terms of a block of items, and the items of each term (as ranges of ``items``)."""

    def __init__(self, texts: list[str | None]):
        own = [item_terms(t) for t in texts]
        self.terms = sorted(set().union(*own)) if own else []
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = np.array([(number[t], i) for i, ts in enumerate(own) for t in ts], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        self.items, self.n_items = pairs[:, 1], len(texts)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))


_MACHINE: dict[str, object] = {}


def _automaton(key: str, terms: list[bytes]):
    """Of one block, kept for the next tasks of this Python worker. Bytes stand as the first 256 signs, so places in a text are bytes."""
    import ahocorasick

    if key not in _MACHINE:
        machine = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            machine.add_word(f" {term.decode('latin-1')} ", k)
        if terms:
            machine.make_automaton()
        _MACHINE.clear()
        _MACHINE[key] = machine
    return _MACHINE[key]


def _matches(machine, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column as (first row, terms of each row, then by distinct (row, term): row, term, tf)."""
    for a, b, data, off in byte_slices(column):
        rows = b - a
        text = np.insert(np.frombuffer(data.tobytes().translate(FOLD), np.uint8), off, GUARD)  # a guard before each row and after the last
        starts = off + np.arange(rows + 1)  # of these guards
        term = text != GUARD
        n = np.diff(np.concatenate([[0], np.cumsum(term[1:] & ~term[:-1])])[starts])
        none = np.zeros(0, np.int64)
        hits = np.fromiter(machine.iter(text.tobytes().decode("latin-1")), np.dtype([("end", np.int64), ("term", np.int64)])) if len(machine) else None
        if hits is None or not len(hits):
            yield a, n, none, none, none
            continue
        row = np.searchsorted(starts, hits["end"], "left") - 1  # a match ends on the guard after its term
        width = int(hits["term"].max()) + 1
        key, tf = np.unique(row * width + hits["term"], return_counts=True)
        yield a, n, key // width, key % width, tf.astype(np.int64)


def _count(docs: DataFrame, key: str, lexicon) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents holding each term of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, df = _automaton(key, lexicon.value.terms), np.zeros(len(lexicon.value.terms), np.int64)
        documents = terms = 0
        for batch in batches:
            for _, n, _, term, _ in _matches(machine, batch.column(0)):
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
                df += np.bincount(term, minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[documents, terms], df[held]]))], ["k", "n"])

    sums = docs.select("text").mapInArrow(scan, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = dict(zip(sums.column("k").to_pylist(), sums.column("n").to_pylist()))
    df = np.zeros(len(lexicon.value.terms), np.int64)
    for k, n in total.items():
        if k >= 0:
            df[k] = n
    return total.get(-2, 0), total.get(-1, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The best rows of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.bar, self.rows, self.held = top, np.zeros(items, np.int64), [], 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        may = score >= np.maximum(self.bar[item], 1)
        self.rows.append((item[may], score[may], doc[may]))
        self.held += int(may.sum())
        if self.held > max(100_000, 4 * self.top * len(self.bar)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        full = rank == self.top - 1
        self.bar[item[full]] = score[full]
        keep = rank < self.top
        self.rows, self.held = [(item[keep], score[keep], doc[keep])], int(keep.sum())
        return self.rows[0]


def _sums(cell: np.ndarray, value: np.ndarray, cells: int) -> np.ndarray:
    """Sums of int64 values by cell, exact: in two halves, each of which doubles hold in full."""
    low = np.bincount(cell, value & 0xFFFFF, cells).astype(np.int64)
    return low + (np.bincount(cell, value >> 20, cells).astype(np.int64) << 20)


def _runs(reach: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose growth in ``reach`` (cumulative) is at most ``limit``, or of one position."""
    a = 0
    while a < len(reach):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _score(docs: DataFrame, key: str, lexicon, documents: int, terms: int, df: np.ndarray, top: int) -> DataFrame:
    """item, score, doc_id, missing: the best of each task for each item of the block."""
    weight = weights(documents, df)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        machine = _automaton(key, lex.terms)
        best, many = Best(lex.n_items, top), np.diff(lex.first)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for at, n, row, term, tf in _matches(machine, batch.column(1)):
                m = np.array([10 + 90 * int(x) * documents // max(terms, 1) for x in n], np.int64)
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                # runs of rows whose scores for all items of the block are held at a time
                step = max(1, 2_000_000 // max(lex.n_items, 1))
                for lo in range(0, len(n), step):
                    p, q = np.searchsorted(row, [lo, lo + step])
                    if p == q:
                        continue
                    score = np.zeros((int(row[q - 1]) - lo + 1) * lex.n_items, np.int64)
                    reach = np.cumsum(many[term[p:q]])
                    for u, v in _runs(reach, 4_000_000):  # a common term names many items
                        t, times = term[p + u:p + v], many[term[p + u:p + v]]
                        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        item = lex.items[np.repeat(lex.first[t], times) + within]
                        cell = np.repeat(row[p + u:p + v] - lo, times) * lex.n_items + item
                        score += _sums(cell, np.repeat(part[p + u:p + v], times), len(score))
                    hit = np.flatnonzero(score)
                    best.add(hit % lex.n_items, score[hit], ids[at + lo + hit // lex.n_items])
        item, score, doc = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=doc == NO_ID)], ["item", "score", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(scan, "item long, score long, doc_id long")


def _ranked(candidates: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item that score above 0."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    numbered = stage(spark, numbered, "search-items")
    size = numbered.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").toArrow()
        lexicon = spark.sparkContext.broadcast(Lexicon(own.column("text").to_pylist()))
        key = uuid.uuid4().hex
        documents, terms, df = _count(docs, key, lexicon)
        candidates = _score(docs, key, lexicon, documents, terms, df, top)
        rows = spark.createDataFrame(pa.table({"item": np.arange(own.num_rows), "row": own.column("row")}))
        candidates = candidates.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(spread(spark))))
        candidates = _ranked(_ranked(candidates, ["item", "share"], top), ["item"], top)
        # at most block_bytes / 64 rows
        part = stage(spark, candidates.join(F.broadcast(rows), "item").select("row", "rank", "doc_id", "score"), "search-block")
        found = part if found is None else found.unionByName(part)
        lexicon.unpersist()
    return found.join(numbered.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
