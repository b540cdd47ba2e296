import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from saiflow.llm.spelling import Block, close_pairs, variants


def brute_words(rows, one_in):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return total


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, one_in=97, least_length=5, least_count=3):
    words = {w: n for w, n in brute_words(rows, one_in).items() if len(w) >= least_length and n >= least_count}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.fixture(scope="module")
def variant_rows():
    """Words in chains of variants, each form twice as common, with letters of both kinds, capitals and ties."""
    rng = random.Random(3)
    bag = []
    for base in ["attention", "Étoile", "señora", "straße", "abcdefgh", "zzzzz", "MARKET"]:
        for k in range(6):
            word = list(base)
            for _ in range(k):
                at, letter = rng.randrange(len(word)), rng.choice("abzéßÿÀ×")
                rng.choice([lambda: word.insert(at, letter), lambda: word.__setitem__(at, letter), lambda: word.pop(at)])()
            bag += ["".join(word)] * rng.choice([3, 6, 7, 14, 30])
    bag += ["chain"] * 3 + ["chains"] * 7 + ["chainsa"] * 16 + ["chainsab"] * 40 + ["chainsaß"] * 40
    bag += ["tieaa"] * 8 + ["tieab"] * 8 + ["tieac"] * 4 + ["l" * 3000] * 3 + ["l" * 3001] * 6 + ["abcd"] * 9 + ["twice"] * 2
    rng.shuffle(bag)
    rows = [(k, rng.choice([" ", "-", "1 ", "\n"]).join(bag[k::12])) for k in range(12)]
    rows += [(None, "Market market's MARKET"), (50, None), (51, ""), rows[3], (52, "a" * 2_000_000)]
    return rows


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)


@pytest.mark.parametrize("block_words", [1024, 3])
def test_variants_equal_brute_force(spark, variant_rows, block_words):
    got = found(variants(spark, wide(spark, variant_rows), block_words=block_words))
    assert got == brute(variant_rows)
    assert sum(r[3] is not None for r in got) > 5 and any(r[5] not in (r[0], r[3]) for r in got)


def test_documents_equal_brute_force(spark, edge_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    assert found(variants(spark, edge_docs, least_length=2, least_count=1)) == brute(rows, least_length=2, least_count=1)


def test_typical_vocabulary_with_every_run_changed(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(150))) for k in range(20)]
    from saiflow.llm import spelling

    words = spelling.count_words(wide(spark, rows).select("doc_id", "text"), drop_one_in=2)
    assert {r.word: r.n for r in words.collect()} == dict(brute_words(rows, 2))
    assert found(variants(spark, wide(spark, rows), block_words=16)) == brute(rows)


def test_pairs_of_blocks():
    rng = random.Random(1)
    short = list({"".join(rng.choice("abÿ") for _ in range(5)) for _ in range(60)})
    long = list({"".join(rng.choice("abÿ") for _ in range(6)) for _ in range(90)})
    a, b = Block("\n".join(short)), Block("\n".join(long))
    assert set(zip(*map(np.ndarray.tolist, close_pairs(a, b, False)))) == {(i, j) for i, x in enumerate(short) for j, y in enumerate(long) if one_edit(x, y)}
    assert set(zip(*map(np.ndarray.tolist, close_pairs(a, a, True)))) == {(i, j) for i, x in enumerate(short) for j, y in enumerate(short) if i < j and one_edit(x, y)}


def test_empty_table(spark, no_docs):
    assert variants(spark, no_docs).count() == 0
