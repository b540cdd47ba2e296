import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from saiflow.llm import imatch
from saiflow.llm.common import settings, stage_alone


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, slots string, _run int")
    return {r.doc_id: r for r in imatch.fingerprints(spark, df, **options).collect()}


def test_edits_and_neighbours(spark):
    rng = random.Random(7)
    rows, text = [], ""
    for k in range(150):
        text = text if k % 10 == 9 else " ".join(f"t{rng.randrange(4000)}" for _ in range(rng.randrange(1, 120)))
        rows.append((k * 3, text, "x", 1))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "日本é x", None, None), (1 << 62, "ab", None, None), (-(1 << 62), "!", None, None)]
    got = run(spark, rows, groups=7)
    order = sorted(rows, key=lambda r: r[0])
    for k, (i, t, _, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        assert got[i].n_chars == len(t) and got[i].edited_text == e
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t == nxt:
            assert got[i].near_next == 1.0
        if e == t:
            assert got[i].near_edited == 1.0 and got[i].fingerprint == got[i].edited_fingerprint
    by_text = {}
    for i, t, _, _ in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    body = [got[r[0]] for r in rows[:150]]
    assert sum(r.near_edited > r.near_next for r in body) > 110
    assert len(set(hashlib.md5(r.fingerprint.encode()).digest() for r in body)) > 120


def test_repeated_rows_and_one_row(spark):
    got = imatch.fingerprints(spark, spark.createDataFrame([(1, "a b c")] * 3 + [(None, "z")], "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    one = run(spark, [(5, "alpha beta gamma delta", "", 0)])[5]
    assert one.edited_text == "alpha beta gamma " [:17] + "alpha"
    assert one.near_next == 1.0


def test_empty_table_and_plan(spark, no_docs, edge_docs):
    assert imatch.fingerprints(spark, no_docs).count() == 0
    plan = imatch.fingerprints(spark, edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("ArrowEval", "BatchEvalPython", "MapInArrow", "MapInPandas"))


def test_terms_of_one_hash_class_are_counted_apart(spark):
    """Two terms of df 1, whose hashes share 20 bits, stay outside the lexicon."""
    seen, pair, k = {}, None, 0
    while pair is None:
        c = xxhash.xxh64_intdigest(f"v{k}".encode(), seed=42) & ((1 << 20) - 1)
        pair = (f"v{seen[c]}", f"v{k}") if c in seen else None
        seen[c], k = k, k + 1
    got = run(spark, [(1, f"one two three {pair[0]}", "", 0), (2, "one two three", "", 0), (3, f"four five {pair[1]}", "", 0)])
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint


def hashed(*numbers):
    """Spark's 64-bit hash of whole numbers of 4 bytes."""
    h = 42
    for k in numbers:
        h = xxhash.xxh64_intdigest((k & 0xFFFFFFFF).to_bytes(4, "little"), seed=h)
    return h


def short(w):
    h = xxhash.xxh64_intdigest(w.encode(), seed=42) >> 32
    return h - (1 << 32) if h >> 31 else h


def brute_slots(words):
    subsets = []
    for k in range(imatch.SUBSETS):
        own, levels = [hashed(w, k) for w in sorted(map(short, words))], []
        for n in range(imatch.LEVELS):
            h, kept = 42, [x for x in own if x & ((1 << n) - 1) == 0]
            for x in kept:
                h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
            levels.append((h & 0xFFFFFF) + 1 if kept else 0)
        subsets.append(levels)
    return [subsets[k][n] for n in range(imatch.LEVELS) for k in range(imatch.SUBSETS)]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for n in range(imatch.LEVELS):
        pairs = list(zip(a, b))[n * imatch.SUBSETS:(n + 1) * imatch.SUBSETS]
        best = max(best, sum(x == y != 0 for x, y in pairs) / max(sum(bool(x or y) for x, y in pairs), 4))
    return best


def test_band_slots_and_likeness_equal_brute_force(spark):
    """One id far from the others and several rows without id among them."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(150)]
    rows = [(k * 3, " ".join(["common"] * (k % 40 > 0) + rng.choices(words, k=rng.randrange(0, 60)) + ["once" + str(k)])) for k in range(150)]
    rows += [(1 << 50, rows[4][1]), (None, "common w1"), (-5, ""), (7, None), (1000, "long " + " ".join(f"u{k % 900}" for k in range(30_000)))]
    terms = lambda t: {w for w in re.split(r"[^0-9a-z]+", (t or "").lower()) if w}
    df = Counter(w for _, t in rows for w in terms(t))
    band = {w for w, n in df.items() if n == 2 or n > 2 and math.log(len(rows) / n) >= 3.0}
    assert band and "common" not in band and "once5" not in band
    slots = lambda t: brute_slots(own if len(own := terms(t) & band) >= 3 else terms(t))
    text = lambda s: "".join(f"{x:07x}" for x in s)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        changed = t[:len(t) - q] + following[:q]
        want[d] = (text(slots(t)), text(slots(changed)), brute_likeness(slots(t), slots(changed)), brute_likeness(slots(t), slots(following)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.fingerprints(spark, docs).collect()
    # with a lexicon of which only a part goes to all tasks
    assert sorted(map(str, imatch.fingerprints(spark, docs, common_terms=5, with_text=False).collect())) == sorted(map(str, imatch.fingerprints(
        spark, docs, with_text=False, groups=1).collect()))
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:])


def test_rows_without_any_id(spark):
    rows = [(None, f"text {k} of several words") for k in range(30)]
    got = imatch.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and all(r.doc_id is None and 0 <= r.near_edited <= 1 for r in got)


def test_staged_plans_leave_no_shuffle_files(spark):
    """The files of a staged plan stayed until the driver collected garbage, and added up."""
    def left():
        time.sleep(2)  # files go after their plan, in the background
        sizes = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {sizes.apply(k).getName() for k in range(sizes.size()) if sizes.apply(k).getName().endswith(".data")}

    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    held = [spark.conf.get(n) for n in names]
    docs = spark.createDataFrame([(k, f"one two w{k % 7} w{k % 11}") for k in range(60)], "doc_id long, text string").repartition(3)
    grouped = docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids"))
    before = left()
    staged = stage_alone(spark, grouped, "trial", {names[1]: "9"})
    assert left() <= before
    assert sorted(r.text for r in staged.collect()) == sorted(r.text for r in grouped.collect())
    assert [spark.conf.get(n) for n in names] == held


def test_terms_stay_with_their_texts(spark, edge_docs, monkeypatch):
    """Terms were exchanged by text, staged, and exchanged once more to meet the few texts that use all their terms."""
    plans = {}

    def noted(spark, df, name, values=None):
        with settings(spark, values or {}):
            plans[name] = df.select("*")._jdf.queryExecution().executedPlan().toString()
        return stage_alone(spark, df, name, values)

    monkeypatch.setattr(imatch, "stage_alone", noted)
    imatch.fingerprints(spark, edge_docs, with_text=False)
    assert set(plans) == {"imatch-lexicon", "imatch-slots", "imatch-whole"}
    dealt_by = set(re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?, ([a-z_]*)", plans["imatch-slots"]))
    assert ("_run", "") in dealt_by and dealt_by <= {("h", ""), ("_run", "")}
