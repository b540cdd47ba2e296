import math
import random
import re
from collections import Counter

import pytest

from saiflow.llm.lexical_search import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top):
    """(item_id, rank, doc_id, score), plain and slow."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total = sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * len(counted)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row long, share string").repartition(3)
    q = spark.createDataFrame([(i, t, 2, "y") for i, t in items], "item_id long, text string, item long, score string")
    got = search(spark, d, q, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def cases(edge_rows):
    rng = random.Random(2)
    vocabulary = ["der", "die", "das", "ab", "abc", "abcd", "bc", "école", "ÉCOLE", "日本", "日", "x1", "É", "İ", "ß", "the"] + [f"w{k}" for k in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "'", "\x00"]) for _ in range(n))
    docs = [(r[0], r[1]) for r in edge_rows] + [(100 + k, text(rng.randrange(1, 80))) for k in range(120)] + [(500, "ab " * 400_000), (501, "...")]
    docs += [(600 + k, "same words here") for k in range(15)] + [(None, "same words here")]
    items = [(k, text(rng.randrange(1, 12))) for k in range(25)] + [(90, None), (91, " .,"), (92, "unknownterm"), (93, "Same WORDS"), (None, "abc der"), (3, "das"), (3, "das")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [4 << 20, 500])
def test_equals_brute_force(spark, cases, block_bytes):
    docs, items = cases
    assert run(spark, docs, items, top=10, block_bytes=block_bytes) == brute(docs, items, 10)


def test_all_documents_of_an_item(spark, cases):
    docs, items = cases
    assert run(spark, docs, items[:4], top=1000) == brute(docs, items[:4], 1000)


def test_empty_tables(spark, cases):
    docs, items = cases
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_many_items_of_a_common_term(spark):
    docs = [(k, "common " + f"w{k} " * 3) for k in range(300)]
    items = [(k, f"common w{k}") for k in range(300)]
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)
