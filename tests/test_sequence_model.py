import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saiflow.operators import labels as L
from saiflow.operators import sequence_model as M


def titles(n, seed):
    """Titles whose words are the same for both labels; their order makes the label."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        y = rng.randrange(2)
        pair = ["涨", "跌"] if y else ["跌", "涨"]
        words = [rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randrange(2, 20))]
        at = rng.randrange(len(words))
        rows.append((k, "".join(words[:at] + pair + words[at:]), y))
    return rows


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    p = M.fit(rng.integers(0, 50, (6, 8)), np.array([0, 1, 0, 1, 1, 0.0]), rounds=1)
    rows, y = M._rows_of(rng.integers(0, 50, (5, 8))), np.array([1, 0, 1, 1, 0.0])
    _, g = M.gradient(p, rows, y)
    for name in p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            if name == "table":
                at = (int(rng.choice(rows.ravel())), at[1])
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((M.gradient(up, rows, y)[0] - M.gradient(down, rows, y)[0]) / 2e-6 - g[name][at]) < 1e-5


def test_held_out_accuracy_is_above_the_word_table(spark):
    learn = spark.createDataFrame(titles(1500, 1), "ord long, title string, label int")
    test = spark.createDataFrame(titles(400, 2) + [(9999, None, 0)], "ord long, title string, label int")
    model = M.train_sequence_model(learn, "ord")
    assert model == M.train_sequence_model(learn.repartition(5), "ord")  # the same in any order of rows
    scored = M.score_sequence_model(model, test)
    assert scored.where("ord = 9999").select("sentiment_label", "sentiment_key", "positive_probs").first() == (None, None, None)
    right = scored.where("ord < 9999").agg(F.avg((F.col("sentiment_label") == F.col("label")).cast("int"))).first()[0]
    spaced = lambda df: df.withColumn("text", F.regexp_replace("title", "(.)", "$1 "))  # noqa: E731  (one word a character)
    prior, words = L.fit_token_bayes(spaced(learn))
    table = L.score_token_bayes(prior, words, spaced(test.where("ord < 9999")), "ord")
    table = table.withColumn("t", F.regexp_replace("text", " ", "")).join(test.select(F.col("title").alias("t"), "label").distinct(), "t")
    by_words = table.agg(F.avg((F.col("sentiment_label") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.95 and by_words < 0.7


def test_a_sequence_of_any_text(spark):
    learn = spark.createDataFrame(titles(200, 3), "ord long, title string, label int")
    odd = spark.createDataFrame([(1, ""), (2, "x" * 100_000), (3, "😀")], "ord long, title string")
    got = M.score_sequence_model(M.train_sequence_model(learn, "ord", length=10, max_rows=100), odd, length=10).collect()
    assert all(0 <= r.positive_probs <= 1 and r.positive_probs + r.negative_probs == pytest.approx(1) for r in got)
    assert M.score_sequence_model(M.train_sequence_model(learn, "ord"), odd.limit(0)).count() == 0
