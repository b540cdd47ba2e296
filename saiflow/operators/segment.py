"""Word segmentation by the most probable path.

A run of Han characters is cut so that the sum of its words' log frequencies is greatest, over all
ways to cut it into words of the dictionary and single characters (an unknown one counts as seen once). Forward
longest match (``text.make_segmenter``) takes the first long word even where
the rest then falls apart; here every word that begins at a place competes.

The dictionary ``(word, freq)`` becomes whole-number weights in Spark and a
prefix trie in each Python worker, so its size is bounded and checked. Equal
sums are settled by the longer first word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import MAX_DICTIONARY, tokens

HAN_RUN = re.compile(r"^[㐀-䶿一-鿿豈-﫿]+$")
#: Weights are logarithms in millionths.
SCALE = 1_000_000


def word_weights(dictionary: DataFrame) -> DataFrame:
    """word, weight: ``SCALE`` times the natural logarithm of each word's share of all occurrences, rounded;
    the empty word has that of a single occurrence. Frequencies of repeated words are added; a null or smaller one is 1."""
    freq = F.greatest(F.coalesce(F.col("freq").cast("long"), F.lit(1)), F.lit(1))
    counted = dictionary.where(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.sum(freq).alias("n"))
    one = dictionary.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(1).cast("long").alias("n"))
    total = F.greatest(F.coalesce(counted.agg(F.sum("n")).scalar(), F.lit(1)), F.lit(1))
    share = counted.unionByName(one).withColumn("_total", total)
    return share.select("word", F.floor(F.log(F.col("n") / F.col("_total")) * SCALE + 0.5).cast("long").alias("weight"))


class Trie:
    """Words by their characters: a node maps a character to a node, and "" to the weight of the word that ends there."""

    def __init__(self, weights: dict[str, int]):
        self.root: dict = {}
        self.unknown = weights[""]
        for word, weight in weights.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            if word:
                node[""] = weight

    def cut(self, run: str) -> list[str]:
        """The words of the best path through ``run``."""
        n = len(run)
        best, step = [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            node, k, top = self.root, i, None
            while k < n and (node := node.get(run[k])):
                k += 1
                if "" in node:
                    sum_ = node[""] + best[k]
                    if top is None or sum_ >= top:  # of equal sums the longer word
                        top, step[i] = sum_, k - i
            single = self.root.get(run[i], {}).get("", self.unknown) + best[i + 1]
            if top is None or single > top:
                top, step[i] = single, 1
            best[i] = top
        out, i = [], 0
        while i < n:
            out.append(run[i:i + step[i]])
            i += step[i]
        return out


def segment_best_path(posts: DataFrame, dictionary: DataFrame, title_col: str = "title", out_col: str = "tokens") -> DataFrame:
    """``posts`` with ``out_col``, the tokens of the title, its Han runs cut along the most probable path.

    ``dictionary``: word, freq; at most ``MAX_DICTIONARY`` words, which each worker holds.
    """
    weights = word_weights(dictionary)
    rows = weights.limit(MAX_DICTIONARY + 2).toArrow()
    if rows.num_rows > MAX_DICTIONARY + 1:
        raise ValueError(f"a segmentation dictionary may hold {MAX_DICTIONARY} words")
    sent = posts.sparkSession.sparkContext.broadcast(dict(zip(rows.column("word").to_pylist(), rows.column("weight").to_pylist())))

    @F.pandas_udf("array<string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(sent.value)
        for lists in batches:
            yield lists.map(lambda toks: None if toks is None else [w for t in toks for w in (trie.cut(t) if HAN_RUN.match(t) else [t])])

    return posts.withColumn(out_col, segment(tokens(title_col)))
