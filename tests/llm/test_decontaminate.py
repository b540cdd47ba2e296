import random

from saiflow.llm import decontaminate as dc


def distance(p, t):
    """Least edit distance of p to any run of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_search_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(800):
        p = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        t = [rng.randrange(4) for _ in range(rng.randint(1, 25))]
        k = rng.randint(0, 4)
        got, want = dc.find_within(p, t, k), distance(p, t)
        assert (got is None) == (want > k) and (got is None or got[0] == want)


def make(rng):
    vocabulary = [f"v{k}" for k in range(500)] + ["the", "of", "in"] * 40
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 8, 15, 30, 55])))) for k in range(40)]
    docs = []
    for k in range(300):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if k % 2:
            w = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, int(0.25 * len(w)))):
                at = rng.randrange(len(w))
                what = rng.random()
                if what < 0.4:
                    w[at] = rng.choice(vocabulary)
                elif what < 0.7:
                    w.insert(at, rng.choice(vocabulary))
                elif len(w) > 1:
                    del w[at]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((k, " ".join(body)))
    return items, docs


def test_recall_against_all_pairs(spark):
    items, docs = make(random.Random(9))
    want = {}
    for d, t in docs:
        for i, x in items:
            p = dc.words(x)
            e = distance(p, dc.words(t))
            if e <= int(0.2 * len(p) + 1e-9):
                want[d, i] = e
    got = dc.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                        block_items=15).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(want) and len(found) >= 0.99 * len(want)
    assert all(found[k] >= want[k] for k in found) and sum(found[k] == want[k] for k in found) >= 0.97 * len(found)
    text = dict(docs)
    for r in got:
        cut = dc.words(text[r.doc_id][r.start_char:r.end_char])
        assert distance(dc.words(dict(items)[r.item_id]), cut) <= r.edits


def test_edges(spark, edge_docs, edge_rows, no_docs):
    passage = edge_rows[10][1]
    items = spark.createDataFrame([(1, passage, "k"), (2, None, "k"), (3, "", "k"), (4, "straße αςς", "k"), (5, passage, "k")], "item_id long, text string, key string")
    got = dc.find_items(edge_docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(d, i) for d in (9, 9, 10, 15) for i in (1, 5)])
    clean = dc.remove_contaminated(edge_docs, items)
    assert clean.columns == edge_docs.columns and clean.count() == len(edge_rows) - 4
    assert dc.find_items(no_docs, items).count() == 0
    assert dc.find_items(edge_docs, items.limit(0)).count() == 0


def test_item_without_id_is_reported_without_one(spark):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(None, item), (0, "alpha beta gamma delta epsilon zeta eta theta"), (7, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (None, item)], "doc_id long, text string")
    got = dc.find_items(docs, benchmark).select("doc_id", "item_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None), (2, 0), (None, None)]))
