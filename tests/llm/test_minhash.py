import random
import re

import numpy as np
import pytest
from saiflow.llm import minhash
from saiflow.llm.components import connected_components


def exact(rows, size, percent):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[root(k)] = min(ids.get(root(k), r[0]), r[0])
    return sorted((str(r[0]), len(s), str(ids.get(root(k)) if s else r[0])) for k, (r, s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_edge_rows_match_all_pairs(spark, edge_docs, edge_rows):
    assert result(minhash.near_duplicates(spark, edge_docs, shingle_words=4)) == exact(edge_rows, 4, 80)


@pytest.mark.parametrize("band_limit", [5000, 4])
def test_chains_of_near_copies(spark, band_limit):
    """Chains whose ends are unlike each other, and copies around one text; also through split bands."""
    rng = random.Random(3)
    rows, text = [], []
    for chain in range(4):
        text = [f"c{chain}w{rng.randrange(1000)}" for _ in range(120)]
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(spark, docs, shingle_words=4, band_limit=band_limit)) == exact(rows, 4, 80)


@pytest.mark.parametrize("band_limit", [5000, 4, 1])
def test_large_band_is_compared_whole(spark, band_limit):
    """Sets that share one band and no other, in a chain and apart from it, in more blocks than one."""
    rng, hasher = random.Random(4), minhash.CirculantMinHash(1)
    mark = lambda w: hasher.signature(minhash.shingle_set(" ".join(w), 4))[0]
    text = [f"w{rng.randrange(1000)}" for _ in range(120)]
    want, rows = mark(text), []
    least = next(k for k in range(117) if mark(text[k:k + 4]) == want)
    common = text[least:least + 4]
    while len(rows) < 40:
        new = list(text)
        for _ in range(2):
            new[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        if mark(new) == want:
            text = new
            rows.append((len(rows), " ".join(text)))
    while len(rows) < 52:
        new = [f"o{rng.randrange(1000)}" for _ in range(30)] + common + [f"o{rng.randrange(1000)}" for _ in range(30)]
        if mark(new) == want:
            rows.append((len(rows), " ".join(new)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(minhash.near_duplicates(spark, docs, shingle_words=4, bands=1, rows=1, band_limit=band_limit))
    assert got == exact(rows, 4, 80) and len({c for *_, c in got}) > 12


def test_threshold_is_exact():
    a = np.arange(90, dtype=np.uint64)
    assert minhash.jaccard_at_least(a, np.arange(10, 100, dtype=np.uint64), 80)
    assert not minhash.jaccard_at_least(a, np.arange(11, 101, dtype=np.uint64), 80)
    assert not minhash.jaccard_at_least(a[:0], a[:0], 80)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    h = minhash.CirculantMinHash(512)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2)
    for share in (0.2, 0.5, 0.8):
        n = int(1000 * share)
        a, b = pool[:1000 - (1000 - n) // 2], np.concatenate([pool[:n], pool[1000:1000 + (1000 - n) // 2]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((h.signature(a) == h.signature(b)).mean() - j) < 0.1


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (2, 1), (20, 10), (10, 30), (None, 3)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10} | {100 + k: 100 for k in range(41)}


def test_empty_table_and_keep_one(spark, no_docs, edge_docs, edge_rows):
    assert minhash.near_duplicates(spark, no_docs).count() == 0
    kept = minhash.keep_one(spark, edge_docs, shingle_words=4)
    assert kept.columns == edge_docs.columns
    parts = {d: c for d, _, c in exact(edge_rows, 4, 80) if d != "None"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({d for d, c in parts.items() if d == c} | {"None"})


def test_keep_one_loses_no_text_that_shares_an_id(spark):
    from conftest import words

    rng = random.Random(12)
    a, b, c = (words(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (3, b), (None, a), (4, ""), (5, None), (2, c), (0, c + " tail")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in minhash.keep_one(spark, docs, shingle_words=4).collect())
    assert got == sorted([("1", a), ("1", b), ("0", c + " tail"), ("None", a), ("4", ""), ("5", "")])
