import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from saiflow.llm import backoff, catalog


def brute(rows, alpha, min_count, bits):
    texts: dict = {}
    for r in rows:
        texts.setdefault(r[0], []).append(backoff.word_classes(r[1], bits).tolist())
    one, two = Counter(), Counter()
    for own in texts.values():
        for w in own:
            one.update(w)
            two.update(zip(w, w[1:]))
    total, out = sum(one.values()), {}
    for d, own in texts.items():
        s = 0.0
        for w in own:
            for k, x in enumerate(w):
                if k and two[w[k - 1], x] >= min_count:
                    s += math.log(two[w[k - 1], x] / one[w[k - 1]])
                else:
                    s += math.log(one[x] / total) + (math.log(alpha) if k else 0)
        out[d] = (sum(map(len, own)), s)
    return out


@pytest.mark.parametrize("frequent", [512, 3])
def test_matches_brute_force(spark, edge_docs, edge_rows, frequent):
    want = brute(edge_rows, 0.4, 2, 22)
    got = {r.doc_id: r for r in backoff.score(spark, edge_docs, frequent=frequent).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d].n_tokens == n and got[d].log_score == pytest.approx(s, abs=1e-6)
        assert (got[d].mean_log_score is None) == (n == 0)


def test_small_tables_and_empty(spark, no_docs):
    assert backoff.score(spark, no_docs).count() == 0
    rows = [(1, "a b a b c"), (2, "b a"), (3, None)]
    got = {r.doc_id: r.log_score for r in backoff.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 0.4, 2, 22)
    assert all(got[d] == pytest.approx(s, abs=1e-9) for d, (_, s) in want.items())


def brute_words(rows, alpha, min_count, order):
    """Of real words, by the recursive definition."""
    texts = [(r[0], (r[1] or "").lower().split()) for r in rows]
    count = Counter(tuple(w[k:k + n]) for _, w in texts for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, out = sum(len(w) for _, w in texts), {}

    def log_score(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        if count[gram] >= min_count:
            return math.log(count[gram] / count[gram[:-1]])
        return math.log(alpha) + log_score(gram[1:])

    for d, w in texts:
        n, s = out.get(d, (0, 0.0))
        out[d] = n + len(w), s + sum(log_score(tuple(w[max(0, k - order + 1):k + 1])) for k in range(len(w)))
    return out


@pytest.mark.parametrize("order, frequent", [(2, 512), (3, 512), (3, 3), (4, 20)])
def test_matches_brute_force_of_words(spark, edge_docs, edge_rows, order, frequent):
    want = brute_words(edge_rows, 0.4, 2, order)
    got = {r.doc_id: r for r in backoff.score(spark, edge_docs, frequent=frequent, order=order).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d].n_tokens == n and got[d].log_score == pytest.approx(s, abs=1e-6)


def test_many_words_share_no_count(spark):
    """Two words whose hashes share their first 22 bits are counted apart."""
    seen, pair, k = {}, None, 0
    while pair is None:
        c = int(backoff.word_classes(f"v{k}", 22)[0])
        pair = (f"v{seen[c]}", f"v{k}") if c in seen else None
        seen[c], k = k, k + 1
    rows = [(1, f"{pair[0]} x " * 3), (2, f"{pair[1]} y"), (3, f"{pair[1]} x")]
    want = brute_words(rows, 0.4, 2, 2)
    got = {r.doc_id: r.log_score for r in backoff.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()}
    assert all(got[d] == pytest.approx(s, abs=1e-9) for d, (_, s) in want.items())


def test_query_scores_trigrams(spark, edge_docs, edge_rows, tmp_path):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_words(edge_rows, 0.4, 2, 3)
    got = {r.doc_id: r.log_score for r in catalog.op9_stupid_backoff(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(got[d] == pytest.approx(s, abs=1e-6) for d, (_, s) in want.items())


def test_words_travel_in_few_bytes_and_meet_without_a_window(spark):
    """Three words of 64 bits, a document and a number took about 22 bytes a word."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(3000)]
    rows = [(k * 7, " ".join(rng.choices(words, [1 / (n + 1) for n in range(3000)], k=400))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = backoff.count_words(docs.select("text"))
    common = spark.sparkContext.broadcast(backoff.common_words(counts, 2500))
    assert 0 < len(common.value[0]) <= 2500
    sent = backoff.document_grams(docs, 3, common, 4).selectExpr("sum(n) as n", "sum(length(packed)) as bytes").first()
    assert sent.n == 500 * 400 and sent.bytes < 9 * sent.n
    plan = backoff.score(spark, docs, order=3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("frequent", [0, 4, 1 << 20])
def test_ids_of_any_size(spark, frequent):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", k=rng.randrange(0, 30)))) for i in [-(1 << 63), (1 << 63) - 1, None, None, 0, 0, 5, -5, 1 << 40] * 4]
    want = brute_words(rows, 0.4, 2, 3)
    got = {r.doc_id: r for r in backoff.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, order=3).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d].n_tokens == n and got[d].log_score == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("order, held", [(2, 1000), (3, 300)])
def test_few_rows_at_a_time_give_the_same(spark, edge_docs, edge_rows, order, held):
    want = brute_words(edge_rows, 0.4, 2, order)
    got = {r.doc_id: r for r in backoff.score(spark, edge_docs.limit(1000), frequent=20, order=order, held=held).collect()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d].n_tokens == n and got[d].log_score == pytest.approx(s, abs=1e-6)


class Steps:
    """Takes the place of a table: gives a step's function itself."""

    def mapInArrow(self, step, schema):
        return step


def peak_mb(step, batches):
    tracemalloc.start()
    out = list(step(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, out


def test_a_task_holds_few_rows(spark):
    """A worker held 160 MB for the words of a chunk, and 190 MB for each million rows of its partition."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{k}" for k in rng.zipf(1.3, 400) % 200_000) for _ in range(2500)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(2500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    common = SimpleNamespace(value=(np.zeros(0, np.int64),) * 3)
    peak, sent = peak_mb(backoff.document_grams(Steps(), 3, common, 50), [docs])
    assert sum(map(sum, (b.column("n").to_pylist() for b in sent))) == 2500 * 400
    assert peak < 120, peak
    peaks = [peak_mb(backoff._score_endings(Steps(), 3, 2, 0.4, 10**6, common, 50), sent * k)[0] for k in (1, 3)]
    assert peaks[1] < 260, peaks
