"""Spelling variants: words one edit apart, and for each word the commoner form it leads to.

Words are compared by their letters. A word's letter counts are a row of a
matrix, and one product of two such matrices (a Gram matrix) gives the squared
distances of all pairs of their rows. An inserted or deleted letter makes
distance 1, a replaced one 2, so pairs at most two apart are kept, and their
edit is verified on the words themselves.

Which matrices meet: words are put in cells of equal length and equal counts
over ``CLASSES`` classes of letters. An edit changes the length by at most one
and the class counts by at most one up and one down, so a cell meets itself,
the cells of its length that one replaced letter leads to, and those of the next length that one
more letter leads to; every pair of words one edit apart is met exactly once.
A cell of more than ``block_words`` words is cut into blocks, which meet block
by block, each pair of blocks as one row, so nothing grows with a cell but the number of rows.

What a pair of blocks yields is combined for each of its words before it is
shuffled. Forms have at least twice their word's count, so a chain of forms is
short, and its end is found by doubling steps in a few joins.

Defined results: a null text has no words; a row without identifier uses an
empty one; repeated rows count as rows of their own; ties between forms go to
the word that is first in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stage

RUN = re.compile("[a-zÀ-ÿ]+")
#: Dimensions of the letter counts: a to z, and six for the other letters. Letters that share one lose no pair.
LETTERS, OTHERS = 32, 6
CLASSES = 5
GROUP = re.Match.group


def letter(codes: np.ndarray) -> np.ndarray:
    """The dimension of each letter, given by its code point."""
    return np.where(codes < 0xC0, codes - 97, 26 + (codes - 0xC0) % OTHERS)


def count_words(docs: DataFrame, drop_one_in: int = 97) -> DataFrame:
    """word, n of all lower-cased runs of letters, after one in ``drop_one_in`` of a document's runs lost a
    letter: both which run and which letter follow from the CRC-32 of ``<doc_id>:<run>``. ``docs``: doc_id, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() changes A-Z alone; runs are counted as they are found, whatever the text's length
                for run, n in Counter(map(GROUP, RUN.finditer(text.encode().lower().decode()))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % drop_one_in == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1:]
                    total[run] += n
                if len(total) > 500_000:
                    yield out()
                    total.clear()
        yield out()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cell_of(word: Column, classes: int = CLASSES) -> Column:
    """Counts of the word's letters by class, as an array; their sum is the length."""
    groups = ["".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if int(letter(np.array(c))) % classes == k) for k in range(classes)]
    length = F.char_length(word)
    # signs of the class that are taken out make the word shorter by their count
    return F.array(*(length - F.char_length(F.translate(word, g, "")) for g in groups))


def neighbours(cell: Column, classes: int = CLASSES) -> Column:
    """The cells that ``cell`` meets: itself, those with one letter more, and later ones with one letter replaced."""
    def changed(up: int, down: int = -1) -> Column:
        return F.array(*(F.get(cell, F.lit(i)) + (int(i == up) - int(i == down)) for i in range(classes)))

    more = [changed(j) for j in range(classes)]
    other = [F.when(F.get(cell, F.lit(k)) > 0, changed(j, k)) for j in range(classes) for k in range(j + 1, classes)]
    return F.concat(F.array(cell, *more), F.filter(F.array(*other), lambda c: c.isNotNull()))


def blocks(words: DataFrame, block_words: int) -> DataFrame:
    """cell, block, words, ns: at most about ``block_words`` words of a cell, in one row."""
    words = words.withColumn("cell", cell_of(F.col("word")))
    # no more rows than words / block_words
    large = words.groupBy("cell").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block_words)
    cut = words.join(F.broadcast(large), "cell", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("word"), F.ceil(F.col("_size") / block_words)), F.lit(0)).cast("int"))
    packed = cut.groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("_w"))
    return packed.select("cell", "block", F.array_join(F.transform("_w", lambda w: w["word"]), "\n").alias("words"),
                         F.transform("_w", lambda w: w["n"]).alias("ns"))


class Block:
    """Words of one length: their code points, letter counts and squared norms."""

    def __init__(self, words: str):
        self.words = words.split("\n")
        self.codes = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32).reshape(len(self.words), -1)
        rows, length = self.codes.shape
        at = np.repeat(np.arange(rows) * LETTERS, length) + letter(self.codes.astype(np.int64)).ravel()
        exact = np.float32 if length < 2048 else np.float64  # so that squares are whole numbers
        self.counts = np.bincount(at, minlength=rows * LETTERS).reshape(rows, LETTERS).astype(exact)
        self.norm = (self.counts * self.counts).sum(1)


def close_pairs(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``a`` and ``b`` one edit apart; with ``same`` (one block) each pair once.
    Words of ``b`` are as long as those of ``a``, or one letter longer."""
    gram = a.counts @ b.counts.T
    gram *= -2
    gram += a.norm[:, None]
    gram += b.norm
    near = gram <= 2
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    length, found = a.codes.shape[1], []
    for at in range(0, len(i), step := max(1, 4_000_000 // max(length, 1))):
        x, y = a.codes[i[at:at + step]], b.codes[j[at:at + step]]
        if y.shape[1] == length:
            found.append((x != y).sum(1) == 1)
        else:  # equal before the letter more, and behind it
            front = np.minimum.accumulate(x == y[:, :-1], axis=1).sum(1)
            back = np.minimum.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            found.append(front + back >= length)
    ok = np.concatenate(found) if found else np.zeros(0, bool)
    return i[ok], j[ok]


def near_words(spark: SparkSession, words: DataFrame, block_words: int = 1024) -> DataFrame:
    """word, n_near, best_n, best of each word of ``words`` (word, n) that has one one edit away."""
    packed = stage(spark, blocks(words, block_words), "spelling-blocks")
    left = packed.select(F.explode(neighbours(F.col("cell"))).alias("to"), F.col("cell").alias("own"), F.col("block").alias("k"),
                         F.col("words").alias("words_a"), F.col("ns").alias("ns_a"))
    right = packed.select(F.col("cell").alias("to"), "block", F.col("words").alias("words_b"), F.col("ns").alias("ns_b"))
    # dealt by number: the rows are few bytes for much work, and would be drawn together
    n = spread(spark)
    pairs = left.repartition(n, "to").join(right.repartition(n, "to"), "to").withColumn("same", F.col("own") == F.col("to")).filter(~F.col("same") | (F.col("k") <= F.col("block")))
    pairs = pairs.select((F.col("same") & (F.col("k") == F.col("block"))).alias("same"), "words_a", "ns_a", "words_b", "ns_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}  # what the last rows yield, combined by word

        def note(word: str, other: str, n: int) -> None:
            have = seen.get(word)
            if have is None:
                seen[word] = [1, n, other]
            else:
                have[0] += 1
                if n > have[1] or n == have[1] and other < have[2]:
                    have[1:] = n, other

        def out() -> pa.RecordBatch:
            near, n, best = zip(*seen.values()) if seen else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())],
                                              ["word", "n_near", "best_n", "best"])

        known: dict[str, Block] = {}  # the last blocks: rows of a cell come together
        for batch in batches:
            for same, wa, na, wb, nb in zip(*(c.to_pylist() if k in (0, 1, 3) else c for k, c in enumerate(batch.columns))):
                known = {w: known.get(w) or Block(w) for w in {wa, wb}}
                a, b = known[wa], known[wb]
                i, j = close_pairs(a, b, same)
                if len(i):
                    na, nb = na.values.to_numpy(), nb.values.to_numpy()
                    for p, q, np_, nq in zip(i.tolist(), j.tolist(), na[i].tolist(), nb[j].tolist()):
                        note(a.words[p], b.words[q], nq)
                        note(b.words[q], a.words[p], np_)
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    found = pairs.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    # the greatest count, and of its words the first
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
             ratio: int = 2, block_words: int = 1024) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of at least ``least_length`` letters and ``least_count`` occurrences."""
    counted = count_words(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    words = stage(spark, counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    near = near_words(spark, words, block_words)
    rows = words.join(near, "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = stage(spark, rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"),
                                    F.when(formed, F.col("best_n")).alias("form_n")), "spelling-forms")
    # each form has `ratio` times the count at least, so that no chain has more steps than the greatest count has powers of it
    most = rows.agg(F.max("n")).first()[0] or 1
    roots, reach = rows.filter("form is not null").select("word", F.col("form").alias("root")), 1
    while ratio ** reach <= most:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        roots = stage(spark, roots.join(ahead, "root", "left").select("word", F.coalesce("_on", "root").alias("root")), "spelling-roots")
        reach *= 2
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
