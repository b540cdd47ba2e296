"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts and unlabelled ones.
With class prior p, the risk is p * R(toxic as toxic) plus the risk of the
negatives, estimated as R(unlabelled as clean) - p * R(toxic as clean). Where a
batch makes that estimate negative (overfitting), the step goes the other way,
which keeps it non-negative.

A word stands for itself, its beginnings of 3 to 6 letters and its last 4,
each hashed to one of 2^bits features; a feature's value is log(1 + count).
Every feature of at least ``least`` confirmed texts is learned, a fixed count,
so words that are rare among toxic texts, or that occur in clean ones too, have
their say. A feature's value is multiplied by the logarithm of its lift (the
ratio of its shares of confirmed and of unlabelled texts, smoothed), so what tells nothing weighs little.

The training sample is bounded: at most ``max_positive`` toxic and
``max_unlabelled`` other texts, whole, chosen by the hash of their ids; their
features go to one task, which learns, and the driver gets its weights. Scoring runs over whole texts in tasks of their own,
and nothing is shuffled but ids.

Defined results: a text that is null or without words gets the classifier's
score of no evidence; without any toxic text all scores are 0; documents
without an id are scored but not learned from; repeated rows are scored each; an id
labelled both ways is toxic; an empty table gives no rows; other columns are ignored (score
and predicted are replaced).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRIP = ".,;:!?\"'()[]{}-"


def word_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        w = w.strip(_STRIP)
        if w:
            out[w] += n
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(which word, feature) of all features of ``words``, none of them empty: the word, its beginnings of 3 to 6 letters, its last 4 if it has more.

    A piece's hash is the sum of the mixed (letter, place) pairs, so sums from the left give all beginnings at once.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    place = np.arange(len(code)) - np.repeat(start, size)
    none = np.zeros(1, np.uint64)
    left = np.concatenate([none, np.cumsum(_mixed(code + (place.astype(np.uint64) + np.uint64(1) << np.uint64(24))), dtype=np.uint64)])
    back = np.repeat(size, size) - place
    right = np.concatenate([none, np.cumsum(_mixed(code + (back.astype(np.uint64) << np.uint64(44))), dtype=np.uint64)])
    which, pieces = [np.arange(len(words))], [left[end] - left[start]]
    for k in range(3, 7):
        own = np.flatnonzero(size >= k)
        which.append(own)
        pieces.append(left[start[own] + k] - left[start[own]] + np.uint64(k))
    own = np.flatnonzero(size > 4)
    which.append(own)
    pieces.append(right[end[own]] - right[end[own] - 4] + np.uint64(9))
    return np.concatenate(which), (_mixed(np.concatenate(pieces)) >> np.uint64(64 - bits)).astype(np.int32)


def text_features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features of a text and their values."""
    count = word_counts(text)
    which, feature = word_features(list(count), bits)
    own, back = np.unique(feature, return_inverse=True)
    times = np.fromiter(count.values(), float, len(count))
    return own, np.log1p(np.bincount(back, times[which], len(own))).astype(np.float32)


@dataclass
class Classifier:
    weights: dict[int, float]  # of the kept features
    bias: float
    bits: int

    def batch_scorer(self):
        """A function of many texts, whose distinct words are looked up together."""
        weights = np.fromiter(self.weights.values(), float, len(self.weights))
        place = np.full(1 << self.bits, -1, np.int32)
        place[np.fromiter(self.weights, np.int64, len(weights))] = np.arange(len(weights))

        def score(texts: list[str | None]) -> np.ndarray:
            cut = pc.split_pattern(pa.array([" ".join((t or "").lower().split()) for t in texts], pa.large_string()), " ")
            coded = cut.flatten().dictionary_encode()
            words = [r.strip(_STRIP) for r in coded.dictionary.to_pylist()]
            some = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)))
            which, feature = word_features([words[k] for k in some.tolist()], self.bits)
            known = place[feature]
            which, known = some[which[known >= 0]], known[known >= 0]
            order = np.argsort(which, kind="stable")
            known, size = known[order], np.bincount(which, minlength=len(words))  # the kept features of each run, one run after the other
            begin = np.cumsum(size) - size
            run_of, first = coded.indices.to_numpy(), cut.offsets.to_numpy().tolist()
            f = np.full(len(texts), self.bias)
            for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                run, n = np.unique(run_of[a:b], return_counts=True)
                times = size[run]
                end = np.cumsum(times)
                if len(end) and end[-1]:
                    each = known[np.arange(end[-1]) + np.repeat(begin[run] - (end - times), times)]
                    at, back = np.unique(each, return_inverse=True)
                    f[k] += (weights[at] * np.log1p(np.bincount(back, np.repeat(n, times)))).sum()
            return 1 / (1 + np.exp(-np.clip(f, -50, 50)))

        return score

    def scorer(self):
        """A function of one text."""
        many = self.batch_scorer()
        return lambda text: float(many([text])[0])


def keep_features(col: np.ndarray, confirmed: np.ndarray, n_pos: int, n_unl: int, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features in at least ``least`` confirmed texts, and the size of the logarithm of their lift.

    ``col``: the features of all texts, ``confirmed``: of which texts they are.
    """
    in_pos, in_unl = np.bincount(col[confirmed], minlength=1 << bits), np.bincount(col[~confirmed], minlength=1 << bits)
    kept = np.flatnonzero(in_pos >= least)
    lift = (in_pos[kept] + 1) / (n_pos + 2) / ((in_unl[kept] + 1) / (n_unl + 2))
    return kept, np.abs(np.log(lift)).astype(np.float32)


def risk(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of the toxic, estimated risk of the clean, slope of the step's objective in each output ``f``).

    The objective is the sum of both risks, or where the second is negative, minus that one.
    """
    pos, unl = positive, ~positive
    n_pos, n_unl = max(1, pos.sum()), max(1, unl.sum())
    as_clean, p_toxic = np.logaddexp(0, f), 1 / (1 + np.exp(-np.clip(f, -50, 50)))
    toxic = prior * (as_clean[pos] - f[pos]).sum() / n_pos
    negatives = as_clean[unl].sum() / n_unl - prior * as_clean[pos].sum() / n_pos
    # slopes of the losses in f: as toxic p - 1, as clean p
    slope = np.zeros(len(f))
    if negatives >= 0:
        slope[pos] = prior * ((p_toxic[pos] - 1) - p_toxic[pos]) / n_pos
        slope[unl] = p_toxic[unl] / n_unl
    else:
        slope[pos] = prior * p_toxic[pos] / n_pos
        slope[unl] = -p_toxic[unl] / n_unl
    return float(toxic), float(negatives), slope


def fit(texts: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, prior: float, bits: int, rounds: int = 150,
        rate: float = 0.05, decay: float = 1e-3, least: int = 2) -> Classifier:
    """Train on features and values of texts; ``positive`` marks the confirmed texts, the others are unlabelled.

    Logistic loss, full batches, Adam steps.
    """
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f, _ in texts])
    col, value = np.concatenate([f for f, _ in texts]), np.concatenate([v for _, v in texts])
    kept, scale = keep_features(col, positive[row], n_pos, n_unl, bits, least)
    at = np.full(1 << bits, -1, np.int32)
    at[kept] = np.arange(len(kept))
    col = at[col]
    row, col, value = row[col >= 0], col[col >= 0], value[col >= 0]
    value = value * scale[col]
    by_col = np.argsort(col, kind="stable").astype(np.int32)
    row_c, value_c = row[by_col], value[by_col]
    full, row_at = np.unique(row, return_index=True)  # texts that have a kept feature, and their first entry
    col_at = np.searchsorted(col[by_col], np.arange(len(kept)))
    size = len(kept)
    w, m, v = (np.zeros(size + 1, np.float32) for _ in range(3))
    for step in range(1, rounds + 1):
        f = np.full(len(texts), w[size], float)
        if size:
            f[full] += np.add.reduceat(value * w[col], row_at)
        slope = risk(f, positive, prior)[2].astype(np.float32)
        grad = np.append(np.add.reduceat(value_c * slope[row_c], col_at) if size else [], slope.sum())
        grad[:size] += decay * w[:size]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return Classifier(dict(zip(kept.tolist(), (w[:size] * scale).tolist())), float(w[size]), bits)


def chosen_texts(docs: DataFrame, labels: DataFrame, may_learn: Column, max_positive: int, max_unlabelled: int, id_col: str,
                 text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(id, text, confirmed of the sample, class prior). ``may_learn``: condition on the id column, for texts and labels alike.

    Only ids are ordered; texts come for the chosen ids, whose number is bounded.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null")
             .withColumnRenamed("id", id_col).filter(may_learn).withColumnRenamed(id_col, "id").groupBy("id").agg(F.max("y").alias("y")))
    counted = known.agg(F.sum("y"), F.count("*")).first()
    prior = (counted[0] or 0) / counted[1] if counted[1] else 0.0
    mix = F.xxhash64(F.lit(11), F.col("id"))
    toxic = known.filter("y = 1").select("id").orderBy(mix, "id").limit(max_positive)
    allowed = ids.withColumnRenamed("id", id_col).filter(may_learn).withColumnRenamed(id_col, "id").distinct()
    other = allowed.orderBy(F.xxhash64(F.lit(12), F.col("id")), "id").limit(max_unlabelled)
    chosen = toxic.select("id", F.lit(True).alias("confirmed")).unionByName(other.select("id", F.lit(False).alias("confirmed")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "confirmed"), float(prior)


def sample_features(texts: DataFrame, bits: int, kept: np.ndarray | None = None) -> DataFrame:
    """id, mark, confirmed, own, value: the features and values of each of ``texts`` (id, text, confirmed), of ``kept`` (sorted)
    alone if that is given; ``mark`` tells texts of one id apart."""
    sent = None if kept is None else texts.sparkSession.sparkContext.broadcast(kept)  # at most 2^bits numbers

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part, rows = batch.slice(at, 100), []
                for text in part.column(1).to_pylist():
                    own, value = text_features(text, bits)
                    if sent is not None:
                        among = np.isin(own, sent.value, assume_unique=True)
                        own, value = own[among], value[among]
                    rows.append((own, value, xxhash.xxh3_64_intdigest(text or "") >> 1))
                own, value, mark = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mark, pa.int64()), part.column(2), pa.array(own, pa.list_(pa.int32())),
                                                  pa.array(value, pa.list_(pa.float32()))], ["id", "mark", "confirmed", "own", "value"])

    return texts.select("id", "text", "confirmed").mapInArrow(make, "id long, mark long, confirmed boolean, own array<int>, value array<float>")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_positive: int = 2000, max_unlabelled: int = 6000, bits: int = 20, least: int = 2) -> Classifier | None:
    """A classifier from the bounded sample; None without any confirmed text.

    Texts become features in tasks; those that ``least`` confirmed texts have are counted first, and one task
    learns from these alone of the whole sample. The driver gets their numbers and weights.
    """
    texts, prior = chosen_texts(docs, labels, may_learn, max_positive, max_unlabelled, id_col, text_col, label_col)
    confirmed = texts.filter("confirmed")
    counted = sample_features(confirmed, bits).select(F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    kept = np.sort(counted.select("f").toArrow().column("f").to_numpy())
    if not len(kept) and confirmed.isEmpty():
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(not c, i, m, o.values.to_numpy(), v.values.to_numpy()) for batch in batches
                  for i, m, c, o, v in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4))]
        sample.sort(key=lambda r: r[:3])  # the order of sums
        marks = np.array([not r[0] for r in sample], bool)
        c = fit([r[3:] for r in sample], marks, min(0.9, max(1e-3, prior)), bits, least=least)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *c.weights], pa.int64()), pa.array([c.bias, *c.weights.values()], pa.float64())], ["feature", "weight"])
        del sample, c
        pa.default_memory_pool().release_unused()

    learned = sample_features(texts, bits, kept).repartition(1).mapInArrow(learn, "feature long, weight double").toArrow()
    weights = dict(zip(learned.column("feature").to_pylist(), learned.column("weight").to_pylist()))
    return Classifier({f: w for f, w in weights.items() if f >= 0}, weights[-1], bits)


def score(spark: SparkSession, docs: DataFrame, classifier: Classifier | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold``) added."""
    if classifier is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    sent = spark.sparkContext.broadcast(pickle.dumps(classifier))  # at most 2^bits weights

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        many = pickle.loads(sent.value).batch_scorer()
        for texts in batches:
            size = np.cumsum([len(t or "") for t in texts])
            cuts = np.searchsorted(size, np.arange(2 << 20, size[-1] if len(size) else 0, 2 << 20)) + 1
            yield pd.Series(np.concatenate([many(list(part)) for part in np.split(texts.to_numpy(), np.unique(cuts))]), dtype=float)

    return docs.withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
