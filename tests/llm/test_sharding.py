import zlib

from saiflow.llm.sharding import histogram_sort


def check(got, rows, shards):
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    most = max((len((r[1] or "").encode()) + 1 for r in rows), default=0)
    mean = sum(x[1] for x in want) / shards
    assert all(abs(sizes.get(k, 0) - mean) <= 2 * most for k in range(shards))


def test_edge_rows(spark, edge_docs, edge_rows):
    got = histogram_sort(spark, edge_docs, shards=4)
    assert {"key", "node", "text"} <= set(got.columns)
    check(got.collect(), edge_rows, 4)


def test_hot_text_is_split(spark):
    rows = [(k * 7 - 3000, "same text " * 5 if k % 3 == 0 else f"text {k} " * (k % 9)) for k in range(3000)]
    got = histogram_sort(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=16).collect()
    check(got, rows, 16)


def test_order_and_extreme_ids(spark):
    rows = [(k, "x") for k in (-(1 << 63), (1 << 63) - 1, 0, 1, -1, None)] * 3
    check(histogram_sort(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect(), rows, 3)


def test_tolerance(spark):
    rows = [(k, "t" * (k % 50)) for k in range(2000)]
    got = histogram_sort(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=4, tolerance=0.05).collect()
    total = sum(r.size for r in got)
    for shard in range(4):
        assert abs(sum(r.size for r in got if r.shard == shard) - total / 4) < 0.05 * total / 4 * 2 + 60


def test_empty_table(spark, no_docs):
    assert histogram_sort(spark, no_docs).count() == 0


def test_main_path_has_no_python(spark, edge_docs):
    plan = histogram_sort(spark, edge_docs, shards=4)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_boundaries_are_the_nearest_of_the_sorted_rows(spark):
    """Against prefix sums of all rows in key order; rows of one key stay together."""
    import random

    import xxhash

    rng = random.Random(3)
    rows = [(rng.randrange(400), rng.choice(["hot text " * 3, f"t{k}" * rng.randrange(40)])) for k in range(1500)] + [(None, None)] * 3 + [(5, "long " * 900)]
    shards = 16
    got = histogram_sort(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
    groups = {}
    for d, t in rows:
        t = t or ""
        key = (xxhash.xxh64_intdigest(t.encode(), seed=42) & ((1 << 63) - 1), -(1 << 63) if d is None else d)
        groups.setdefault(key, []).append((d, t))
    ends, at = [], 0
    for key in sorted(groups):
        size = sum(len(t.encode()) + 1 for _, t in groups[key])
        ends.append((key, at, at + size))
        at += size
    pieces = 8
    cuts = []
    for t in range(pieces, shards * pieces, pieces):
        target = at * t // (shards * pieces)
        k = next(i for i, e in enumerate(ends) if target <= e[2])
        cuts.append(k if target - ends[k][1] <= ends[k][2] - target else k + 1)
    want = {}
    for i, (key, _, _) in enumerate(ends):
        for d, t in groups[key]:
            want.setdefault((d, t), sum(c <= i for c in cuts))
    assert len(got) == len(rows) and all(r.shard == want[r.doc_id, r.text or ""] for r in got)
