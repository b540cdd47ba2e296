"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Method: best-fit decreasing. Pieces are placed from the longest to the
shortest, each into the open bin with the least room that still holds it; a
segment tree over the remaining capacities finds that bin in logarithmic time.

Only lengths decide the packing, and there are at most ``capacity`` of them.
So Spark counts the pieces of each length, the placement runs once on that
histogram (its size depends on the capacity, not on the data; equal bins are
kept as runs of bin numbers), and the pieces look their place up by their rank
among the pieces of their length. Ranks come from windows over (length, salt):
a length that holds a third of all pieces is ranked by many tasks.

Defined results: a null text is the empty text (its piece holds the end token
alone); rows without id and repeated rows are packed as rows of their own; equal lengths are
placed in any order of the rows; an empty table gives no rows; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, spread, stage


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while some open bin has that room."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, room: int, present: bool) -> None:
        k = self.base + room
        self.any[k] = present
        while k > 1:
            k >>= 1
            now = self.any[2 * k] | self.any[2 * k + 1]
            if self.any[k] == now:
                break
            self.any[k] = now

    def tightest(self, need: int) -> int:
        """The least room >= need of an open bin, or -1."""
        k = self.base + need
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.base:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.base
            k >>= 1
        return -1


@dataclass
class Plan:
    """Runs of equal placements, sorted by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << np.int64(44)
        k = np.searchsorted(self.length * wide + self.rank, length * wide + rank, "right") - 1
        nth = rank - self.rank[k]
        return self.bin[k] + nth // self.per_bin[k], self.offset[k] + nth % self.per_bin[k] * length


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing for ``histogram`` (length -> pieces), all pieces of a length at once.

    A bin that takes a piece becomes tighter, so it also takes the next ones
    of that length until they no longer fit: room r holds r // length of them.
    """
    tree = CapacityTree(capacity)
    rooms: dict[int, list[list[int]]] = {}  # room -> runs [first bin, bins]
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            tree.set(room, True)
        runs = rooms[room]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, n])

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, fit = capacity, capacity // length
                first, n = bins, -(-left // fit)
                bins += n
            else:
                fit = room // length
                runs = rooms[room]
                first, have = runs[-1]
                n = min(have, -(-left // fit))
                if n == have:
                    runs.pop()
                else:  # take the run's last bins, the rest stays
                    first += have - n
                    runs[-1][1] -= n
                if not runs:
                    del rooms[room]
                    tree.set(room, False)
            took = min(left, n * fit)
            rows.append((length, rank, first, fit, capacity - room))
            full, over = divmod(took, fit)
            if full and room - fit * length:
                put(room - fit * length, first, full)
            if over and room - over * length:
                put(room - over * length, first + full, 1)
            rank, left = rank + took, left - took
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*cols, bins=bins)


class WordTokenizer:
    """Ids of a word-level BPE file that lower-cases its input and drops white space.

    Such a tokenizer cuts at white space and between letters and other signs
    before it merges, so a run between spaces has the same ids anywhere, and a
    comma or full stop after a letter is a run of its own. The distinct runs of
    many texts are looked up once; new ones are encoded by the library. What is known is kept in
    two generations of at most ``keep`` runs: when the younger is full it
    becomes the elder, from which runs that occur again come back.
    """

    # not after the capital whose lower case ends in a mark, which goes with the sign
    SIGN = re.compile(r"[,.](?<=[^\W\d_\u0130][,.])(?= |$)")

    def __init__(self, file: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.keep = Tokenizer.from_file(file), keep
        self.young: dict[str, bytes] = {"": b""}
        self.elder: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> str:
        """Lower case where that is the same in any order with the library's steps, spaces for common white space and before signs."""
        if "<" not in text and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if unicodedata.is_normalized("NFC", low):
                text = low
        return self.SIGN.sub(r" \g<0>", text.replace("\n", " ").replace("\t", " ").replace("\r", " "))

    def _ids(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs."""
        ids = list(map(self.young.get, runs))
        if None in ids:
            missing = [k for k, b in enumerate(ids) if b is None]
            again = {k: b for k in missing if (b := self.elder.get(runs[k])) is not None}
            new = [k for k in missing if k not in again]
            again.update(zip(new, self._library([runs[k] for k in new])))
            for k, b in again.items():
                ids[k] = b
            self.young.update((runs[k], b) for k, b in again.items())
            if len(self.young) > self.keep:
                self.elder, self.young = self.young, {}
        return ids

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of the runs of all texts, one after the other: which of the distinct runs each is, the ids of these, and where each text's runs begin."""
        cut = pc.split_pattern(pa.array([self._plain(t) for t in texts], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        return coded.indices.to_numpy(), self._ids(coded.dictionary.to_pylist()), cut.offsets.to_numpy()

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        which, ids, first = self._looked_up(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(size[which])])[first])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (and the last end)."""
        which, ids, first = self._looked_up(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, times = np.cumsum(size) - size, size[which]
        end = np.cumsum(times)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(begin[which] - (end - times), times)
        return np.frombuffer(b"".join(ids), "<u4")[at], np.concatenate([[0], end])[first]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, first = self.encode_all(texts)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield ids[a:b].tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(file: str) -> WordTokenizer:
    """One per Python worker, so that what is known serves later tasks too."""
    return WordTokenizer(file)


def tokenized_pieces(docs: DataFrame, file: str, capacity: int, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token pieces of each document: id, piece, start, length, ids_crc32 and the ids themselves.

    A document's ids end with ``end_id``; only longer ones than ``capacity``
    are cut, into pieces of ``capacity`` ids with a shorter last one.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
              pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    fields += [pa.field("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(file)
        for batch in batches:
            for a, b, _, _ in byte_slices(batch.column(1), 2 << 20):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, first = tokenizer.encode_all(texts)
                ids = np.ascontiguousarray(np.insert(ids, first[1:], end_id), "<u4")  # the end token after each text
                first = first + np.arange(len(first))
                size = np.diff(first)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = first[doc] + start
                crc = [zlib.crc32(ids[p:q]) for p, q in zip(at.tolist(), (at + length).tolist())]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:  # pieces stand in the order of their ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        pa.default_memory_pool().release_unused()  # what the worker keeps between tasks is the known runs

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, ddl)


def rank_within(pieces: DataFrame, salts: int) -> DataFrame:
    """Add ``rank`` (from 0, gapless) of each piece among the pieces of its length."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    before = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
              .drop("_n"))
    order = ["doc_id", "piece", "ids_crc32", *(c for c in pieces.columns if c == "row")]  # rows without id are told apart by their number
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    return (salted.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_salt"])
            .withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_salt"))


def pack(spark: SparkSession, docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack the documents' token pieces: adds sequence_id and offset to ``tokenized_pieces``."""
    pieces = tokenized_pieces(docs, file, capacity, end_id, id_col, text_col, with_ids)
    # a number of each piece, fixed by staging: ids may be null and rows may be repeated
    pieces = stage(spark, pieces.withColumn("row", F.monotonically_increasing_id()) if with_ids else pieces, "pack-pieces")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["row"] * with_ids
    narrow = pieces.select(*kept)
    # at most `capacity` rows come to the driver, whatever the number of documents
    histogram = {r[0]: r[1] for r in narrow.groupBy("length").count().collect()}
    plan = best_fit_decreasing(histogram, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", row long" * with_ids + ", sequence_id long, offset long"
    ranked = rank_within(narrow, spread(spark)).select(*kept, F.col("rank").cast("long").alias("rank"))
    placed = ranked.mapInArrow(place, ddl)
    if not with_ids:
        return placed
    return (placed.join(pieces.select("row", "ids"), "row")
            .select("doc_id", "piece", "ids_crc32", "start", "length", "sequence_id", "offset", "ids"))
