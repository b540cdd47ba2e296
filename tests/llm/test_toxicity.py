import random

import numpy as np
from pyspark.sql import functions as F
from saiflow.llm import toxicity


def make(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["snarl", "grumf", "blaxo" + rng.choice("abcdef")])
        rows.append((k, " ".join(w), "x"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = make(1500, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.train(docs, table, toxicity.fold() != 1)
    got = toxicity.score(spark, docs.drop("score"), found).withColumn("held", toxicity.fold() == 1).collect()
    held = [r for r in got if r.held]
    right = [(r.doc_id % 8 == 0) == bool(r.predicted) for r in held]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    caught = [r.predicted for r in held if r.doc_id % 8 == 0]
    assert np.mean(caught) > 0.9


def test_negative_risk_stays_bounded():
    """A prior above the truth drives the plain estimate below zero; scores still separate."""
    rows, _ = make(600, 6)
    features = [toxicity.text_features(t, 18) for _, t, _ in rows]
    confirmed = np.array([k % 16 == 0 for k in range(600)])
    c = toxicity.fit(features, confirmed, 0.3, 18)
    score = c.scorer()
    s = np.array([score(t) for _, t, _ in rows])
    toxic = np.arange(600) % 8 == 0
    assert s[toxic].min() > np.median(s[~toxic])


def test_long_tailed_vocabulary():
    """Toxic words of which each is in under 3 % of the toxic texts."""
    rng = random.Random(9)
    bad = ["".join(rng.choices("bcdfghjklmnpqrstvz", k=8)) for _ in range(400)]

    def texts(n):
        out = []
        for k in range(n):
            w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(60, 120))]
            if k % 8 == 0:
                w += rng.sample(bad, 6)
            out.append(" ".join(w))
        return out

    learn = texts(3000)
    confirmed = np.arange(3000) % 16 == 0
    c = toxicity.fit([toxicity.text_features(t, 18) for t in learn], confirmed, 0.125, 18)
    score = c.scorer()
    predicted = np.array([score(t) >= 0.7 for t in texts(800)])
    toxic = np.arange(800) % 8 == 0
    assert predicted[toxic].mean() > 0.75 and predicted[~toxic].mean() < 0.03


def test_edge_rows_and_no_labels(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(12, 1), (12, 0), (None, 1), (3, None), (9, 0)], "doc_id long, toxic int")
    c = toxicity.train(edge_docs, labels, F.lit(True))
    got = toxicity.score(spark, edge_docs, c).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").split()}
    assert len(empty) == 1
    assert toxicity.train(edge_docs, labels.filter("toxic = 0"), F.lit(True)) is None
    assert {(r.score, r.predicted) for r in toxicity.score(spark, edge_docs, None).collect()} == {(0.0, 0)}
    assert toxicity.train(no_docs, labels.limit(0), F.lit(True)) is None
    assert toxicity.score(spark, no_docs, c).count() == 0


def test_slopes_equal_differences_of_the_risk():
    """On both sides of zero of the clean texts' estimated risk, which is compared with its plain formula."""
    rng = np.random.default_rng(3)
    positive = np.arange(30) % 3 == 0
    signs = set()
    for shift, prior in ((0.0, 0.2), (6.0, 0.9), (-3.0, 0.5), (4.0, 0.8)):
        f = rng.normal(0, 2, 30) + np.where(positive, shift, 0)
        loss = lambda z, y: np.log(1 + np.exp(-z if y else z))
        toxic, clean, slope = toxicity.risk(f, positive, prior)
        assert np.isclose(toxic, prior * np.mean([loss(z, 1) for z in f[positive]]))
        assert np.isclose(clean, np.mean([loss(z, 0) for z in f[~positive]]) - prior * np.mean([loss(z, 0) for z in f[positive]]))
        goal = (lambda g: sum(toxicity.risk(g, positive, prior)[:2])) if clean >= 0 else (lambda g: -toxicity.risk(g, positive, prior)[1])
        signs.add(clean >= 0)
        for k in range(30):
            step = np.eye(30)[k] * 1e-6
            assert np.isclose((goal(f + step) - goal(f - step)) / 2e-6, slope[k], atol=1e-7)
    assert signs == {True, False}


def test_features_of_words():
    """A piece has one feature wherever it comes from, and a text's features are those of its words."""
    words = ["grumf", "grumfy", "gru", "ab", "blaxoumf", "日本語です", "a"]
    which, feature = toxicity.word_features(words, 40)
    own = [set(feature[which == k].tolist()) for k in range(len(words))]
    assert [len(o) for o in own] == [5, 6, 2, 1, 6, 5, 1]
    assert len(own[0] & own[1]) == 3 and len(own[0] & own[2]) == 1 and not own[1] & own[4]
    for k, w in enumerate(words):
        assert set(toxicity.word_features([w], 40)[1].tolist()) == own[k]
    f, v = toxicity.text_features("Grumf, ab ab (ab) ...", 40)
    want = {x: 1 for x in own[0]} | {x: 3 for x in own[3]}
    assert f.tolist() == sorted(want) and np.allclose(v, np.log1p([want[x] for x in f.tolist()]))
    assert [len(x) for x in toxicity.text_features(None, 20)] == [0, 0]


def test_many_texts_score_as_each_alone():
    texts = [None, "", "...", "grumf grumf ab", "w1 w2 w1, unknown", "ab " * 5000]
    f = toxicity.text_features("grumf ab w1 w2", 18)[0]
    c = toxicity.Classifier({int(x): 0.1 * (k - 4) for k, x in enumerate(f)}, 0.3, 18)
    alone = c.scorer()
    got = c.batch_scorer()(texts)
    for t, p in zip(texts, got):
        own, value = toxicity.text_features(t, 18)
        z = 0.3 + sum(c.weights.get(x, 0.0) * y for x, y in zip(own.tolist(), value.tolist()))
        assert np.isclose(p, 1 / (1 + np.exp(-z)), atol=1e-6) and np.isclose(p, alone(t))
