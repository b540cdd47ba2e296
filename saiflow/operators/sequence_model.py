"""A sentiment classifier that sees the order of characters (N7, a trained model for N4).

A title becomes a sequence of fixed length (C12: cut, or zeros at its end).
Each character has a learned vector; filters over ``WIDTH`` neighbours look for
short patterns, the strongest answer of each filter counts, and a logistic
unit decides. Unlike the token table of ``labels`` it can tell "not good, bad" from "not bad, good".

Training is numpy in one task, on a bounded sample (``max_rows`` labelled
titles, chosen by the hash of their key); the driver gets the parameters, under a megabyte. Scoring is
``predict_batch_udf``: each Python worker loads the model once and scores batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.exprs import pad_codes

#: Rows of the character table (codes share a row by their remainder; 0 is the padding), vector size, filters, neighbours.
TABLE, SIZE, FILTERS, WIDTH = 4096, 16, 32, 3


def _rows_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, codes % (TABLE - 1) + 1, 0).astype(np.int64)


def _forward(p: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    n, length = rows.shape
    vectors = p["table"][rows]  # n, length, SIZE
    windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * SIZE)
    answers = windows @ p["filters"] + p["filter_bias"]
    at = answers.argmax(1)
    best = np.take_along_axis(answers, at[:, None], 1)[:, 0]
    hidden = np.maximum(best, 0)
    return windows, at, best, hidden, hidden @ p["weights"] + p["bias"]


def probability(p: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """P(label 1) of sequences of character codes (n, length)."""
    z = _forward(p, _rows_of(codes))[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gradient(p: dict[str, np.ndarray], rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss and its slope in each parameter."""
    windows, at, best, hidden, z = _forward(p, rows)
    n = len(rows)
    loss = float((np.logaddexp(0, z) - labels * z).mean())
    dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
    dbest = dz[:, None] * p["weights"] * (best > 0)
    own = np.take_along_axis(windows, at[:, :, None].transpose(0, 1, 2), 1)  # n, FILTERS, WIDTH * SIZE: the window each filter chose
    g = {"weights": hidden.T @ dz, "bias": np.array([dz.sum()]), "filters": np.einsum("nfw,nf->wf", own, dbest), "filter_bias": dbest.sum(0),
         "table": np.zeros_like(p["table"])}
    back = (dbest[:, :, None] * p["filters"].T[None]).reshape(n, FILTERS, WIDTH, SIZE)
    touched = rows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDTH)]
    np.add.at(g["table"], touched.ravel(), back.reshape(-1, SIZE))
    return loss, g


def fit(codes: np.ndarray, labels: np.ndarray, rounds: int = 25, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` passes in small batches (Adam steps), the same for the same input."""
    rng = np.random.default_rng(seed)
    p = {"table": rng.normal(0, 0.1, (TABLE, SIZE)), "filters": rng.normal(0, 0.2, (WIDTH * SIZE, FILTERS)), "filter_bias": np.zeros(FILTERS),
         "weights": rng.normal(0, 0.2, FILTERS), "bias": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rows, step = _rows_of(codes), 0
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own, step = order[lo:lo + batch], step + 1
            for k, g in gradient(p, rows[own], labels[own])[1].items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


def train_sequence_model(labelled: DataFrame, key_col: str, text_col: str = "title", label_col: str = "label", length: int = K.SEQUENCE_LENGTH,
                         max_rows: int = 8000) -> bytes:
    """A model from at most ``max_rows`` rows with a text and a label of 0 or 1, as bytes (a numpy archive)."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1))
    mix = F.xxhash64(F.lit(3), F.col(key_col), F.col(text_col))
    sample = rows.select(mix.alias("mix"), pad_codes(text_col, length).alias("seq"), F.col(label_col).cast("int").alias("y")).orderBy("mix", "seq", "y").limit(max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        codes, labels = np.array([r[1] for r in got], np.int64).reshape(-1, length), np.array([r[2] for r in got], float)
        out = io.BytesIO()
        np.savez_compressed(out, **{k: v.astype(np.float32) for k, v in fit(codes, labels).items()})
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return bytes(sample.repartition(1).mapInArrow(learn, "model binary").first().model)


def load_model(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def score_sequence_model(model: bytes, posts: DataFrame, text_col: str = "title", length: int = K.SEQUENCE_LENGTH) -> DataFrame:
    """``posts`` with sentiment_label, sentiment_key, positive_probs and negative_probs; a null text has null ones."""

    def make():
        p = load_model(model)
        return lambda codes: probability(p, codes.astype(np.int64)).astype(np.float64)

    score = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=1024, input_tensor_shapes=[[length]])
    p1 = F.when(F.col(text_col).isNotNull(), score(F.coalesce(pad_codes(text_col, length), F.array_repeat(F.lit(0), length))))
    positive = F.col("positive_probs") > 0.5
    return posts.withColumn("positive_probs", p1).withColumns({
        "negative_probs": 1 - F.col("positive_probs"), "sentiment_label": positive.cast("int"),
        "sentiment_key": F.when(positive, "positive").when(~positive, "negative")})
