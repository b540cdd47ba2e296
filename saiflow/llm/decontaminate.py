"""Benchmark passages in documents, found by CGK embedding and bit-sampling LSH and confirmed by edit distance.

Texts are sequences of words (lower case, without common punctuation). A
document holds an item if some run of its words is within
``floor((1 - similarity) * words of the item)`` word edits of it.

1. The shared-gram bound: strings within k edits share at least
   ``n - q + 1 - k * q`` of an item's n - q + 1 word q-grams. Documents that
   hold fewer of an item's grams cannot hold the item; this bound loses nothing.
   For the rest, each hit names a window: as many words as the item has, at
   the place where the item would start.
2. CGK embedding: a random walk over the words, which stays or steps on by a
   random bit for each (step, word), maps edit distance to Hamming distance.
   Every repetition samples a few coordinates; windows that agree with an
   item in all of a repetition's samples are candidates. ``walks`` times
   ``samples`` repetitions reach the wanted recall.
3. Candidates are confirmed exactly: bit-parallel search of the item in the
   window and the words around it.

Items are read to the driver in blocks of about ``block_items`` items, one at a
time, each a job of its own, so what driver and tasks hold is bounded; more
items mean more passes over the documents. Documents are never shuffled.

Defined results: null or empty texts hold nothing, and null or empty items are
held by nothing; an item without id is reported with a null one; an item of fewer than five words must occur exactly; repeated
rows are reported each; of several places in a document the nearest one, then the first, is
reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

PUNCTUATION = ".,;:!?\"()[]{}"
_WORD = re.compile(r"[^\s.,;:!?\"()\[\]{}]+")


def words(text: str | None) -> list[str]:
    t = (text or "").lower()
    for sign in PUNCTUATION:
        if sign in t:
            t = t.replace(sign, " ")
    return t.split()


def gram_size(n: int, edits: int, most: int = 3) -> int:
    """The largest q <= ``most`` for which ``edits`` edits leave a shared gram."""
    for q in range(min(most, n), 0, -1):
        if n - q + 1 - edits * q >= 1:
            return q
    return 1


def find_within(pattern: list[int], text: list[int], edits: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of ``pattern`` anywhere in ``text``, the first such end; None above ``edits``.

    Myers' bit-parallel search: bit i of the vectors stands for the pattern's first i + 1 words.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, p in enumerate(pattern):
        where[p] = where.get(p, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for j, t in enumerate(text):
        eq = where.get(t, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, zero & up
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # a match may start anywhere: no carry in
        up, down = minus | ~(zero | plus) & full, plus & zero
        if score <= edits and (best is None or score < best[0]):
            best = score, j + 1
    return best


class ItemIndex:
    """Benchmark items ready for search: vocabulary, grams, and LSH tables by item length."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float, walks: int, samples: int, sampled: int, seed: int = 5):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray, int]] = []  # id, words, edits
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item, np.array(ids, np.int64), int((1 - similarity) * len(ids) + 1e-9)))
        self.base = len(self.vocabulary) + 2
        self.least, grams = [], {}
        for k, (_, ids, edits) in enumerate(self.items):
            q = gram_size(len(ids), edits)
            self.least.append(max(1, len(ids) - q + 1 - edits * q))
            for at in range(len(ids) - q + 1):
                grams.setdefault(q, []).append((self._code(ids[at:at + q]), k, at))
        self.least = np.array(self.least, np.int64)
        self.grams = {}
        for q, rows in grams.items():
            code, item, at = (np.array(c, np.int64) for c in zip(*sorted(rows)))
            distinct, first = np.unique(code, return_index=True)
            self.grams[q] = distinct, np.append(first, len(code)), item, at
        self.walks, self.samples, self.sampled = walks, samples, sampled
        self.rng = np.random.default_rng(seed)
        self.step = np.random.default_rng(seed + 1).integers(0, 2, (walks, 3 * max([len(i[1]) for i in self.items], default=1), 1 << 10), dtype=np.int8)
        self.tables: dict[int, tuple[np.ndarray, dict]] = {}
        by_length: dict[int, list[int]] = {}
        for k, (_, ids, _) in enumerate(self.items):
            by_length.setdefault(len(ids), []).append(k)
        for n, own in by_length.items():
            at = self.rng.integers(0, 2 * n, (walks, samples, sampled))  # walks have mostly ended by three times the length
            table: dict[tuple, list[int]] = {}
            for k, key in zip(own, self._keys(np.stack([self.items[k][1] for k in own]), at)):
                for r, h in enumerate(key):
                    table.setdefault((r, h), []).append(k)
            self.tables[n] = at, table

    def _code(self, ids) -> int:
        code = 0
        for i in ids:
            code = code * self.base + int(i)
        return code

    def _embed(self, rows: np.ndarray) -> np.ndarray:
        """All CGK walks over rows of words (0: a word of no item): 3n symbols each, -1 after the end."""
        m, n = rows.shape
        ends = np.concatenate([rows, np.full((m, 1), -1, np.int64)], axis=1)
        at, every, walk = np.zeros((self.walks, m), np.int64), np.arange(m)[None, :], np.arange(self.walks)[:, None]
        out = np.empty((3 * n, self.walks, m), np.int64)
        for j in range(3 * n):
            symbol = out[j] = ends[every, at]
            at += self.step[walk, j, symbol & 0x3FF]
            np.minimum(at, n, out=at)
        return out

    def _keys(self, rows: np.ndarray, at: np.ndarray) -> list[list[int]]:
        """Of each row, the sampled coordinates of every repetition as one number."""
        e, keys = self._embed(rows), []
        for w in range(self.walks):
            for sampled in at[w]:
                h = np.zeros(len(rows), np.int64)
                for c in sampled:
                    h = h * np.int64(1_000_003) + e[c, w] + 2
                keys.append(h)
        return np.stack(keys, 1).tolist()

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Items whose LSH buckets hold a window of the text: {item number: [window starts]}."""
        found: dict[int, list[int]] = {}
        windows: dict[int, set[int]] = {}
        for q, (distinct, first, item, at) in self.grams.items():
            if len(ids) < q:
                continue
            m = len(ids) - q + 1
            known = ids[:m] > 0
            for k in range(1, q):
                known &= ids[k:k + m] > 0
            place = np.flatnonzero(known)
            if not len(place):
                continue
            code = np.zeros(len(place), np.int64)
            for k in range(q):
                code = code * self.base + ids[place + k]
            slot = np.searchsorted(distinct, code)
            slot[slot == len(distinct)] = 0
            hit = distinct[slot] == code
            place, slot = place[hit], slot[hit]
            many = first[slot + 1] - first[slot]
            row = np.repeat(first[slot], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            # distinct grams of an item count once for each place in the item, at most as often as in the text
            who, start = item[row], np.repeat(place, many) - at[row]
            offsets = np.unique(np.stack([who, at[row]], 1), axis=0)[:, 0]
            enough = np.bincount(offsets, minlength=len(self.items)) >= self.least
            keep = enough[who]
            for k, s in set(zip(who[keep].tolist(), start[keep].tolist())):
                windows.setdefault(len(self.items[k][1]), set()).add(s)
        for n, starts in windows.items():
            order = sorted(starts)
            padded = np.concatenate([np.zeros(n, np.int64), ids, np.zeros(n, np.int64)])
            at, table = self.tables[n]
            for c in range(0, len(order), 1024):
                part = order[c:c + 1024]
                rows = padded[np.array(part)[:, None] + n + np.arange(n)[None, :]]
                for s, key in zip(part, self._keys(rows, at)):
                    for k in {k for r, h in enumerate(key) for k in table.get((r, h), ())}:
                        found.setdefault(k, []).append(s)
        return found

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, edits, words of the item, first word, end word) of each item that the text holds."""
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, [0] * len(w)), np.int64, len(w))
        out = []
        for k, starts in self.candidates(ids).items():
            item, pattern, edits = self.items[k]
            n, best = len(pattern), None
            for s in sorted(starts):
                lo, hi = max(0, s - edits), min(len(ids), s + n + edits)
                m = find_within(pattern.tolist(), ids[lo:hi].tolist(), edits)
                if m and (best is None or m[0] < best[0]):
                    back = find_within(pattern.tolist()[::-1], ids[lo:lo + m[1]].tolist()[::-1], m[0])
                    best = m[0], lo + m[1] - (back[1] if back else n), lo + m[1]
            if best:
                out.append((item, best[0], n, best[1], best[2]))
        return out


def char_span(text: str, first: int, end: int) -> tuple[int, int]:
    """Characters that the words first..end - 1 of a text cover."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return spans[first][0], spans[min(end, len(spans)) - 1][1]


def _hits(index: ItemIndex, text: Column) -> Column:
    """What ``index`` finds in a text, as array<struct<item_id, edits, item_words, start_char, end_char>>."""

    @F.pandas_udf("array<struct<item_id:long,edits:int,item_words:int,start_char:int,end_char:int>>")
    def hits(texts: pd.Series) -> pd.Series:
        names = ("item_id", "edits", "item_words", "start_char", "end_char")
        return pd.Series([[dict(zip(names, (item, edits, n_words, *char_span(t, first, end))))
                           for item, edits, n_words, first, end in index.search(t)] for t in texts], dtype=object)

    return hits(text)


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8,
                walks: int = 16, samples: int = 6, sampled: int = 3, block_items: int = 20_000) -> Iterator[tuple[ItemIndex, bool]]:
    """(index, whether it is the last) of the items, block by block: one block at a time is read to the driver, when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null").distinct()
    blocks = max(1, -(-items.count() // block_items))
    for n in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        order = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda i: (i[0] is not None, i[0] or 0, i[1]))
        yield ItemIndex(order, similarity, walks, samples, sampled), n == blocks - 1


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, edits, item_words, start_char, end_char: one row for each document and item it holds.

    More than one block of items are as many jobs, each written before the next block is read.
    """
    found = None
    for index, last in item_blocks(benchmark, **options):
        hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hits(index, F.col(text_col)).alias("hits")).select("doc_id", F.inline("hits"))
        hits = hits if last and found is None else stage(docs.sparkSession, hits, "benchmark-hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item; a null text holds none. Blocks of items go one after the other, as in ``find_items``."""
    for index, last in item_blocks(benchmark, **options):
        docs = docs.withColumn("_dc_hits", _hits(index, F.col(text_col))).filter(F.size("_dc_hits") == 0).drop("_dc_hits")
        docs = docs if last else stage(docs.sparkSession, docs, "benchmark-rest")
    return docs
