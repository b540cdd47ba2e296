import hashlib
import os
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from saiflow.llm.stream_dedup import Deduplicator

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, keep_id, group_size, digest) of (doc_id, text) rows; how many rows of each group stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted(((i, max(ids, key=key), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str), len(groups)


def found(d):
    rows = d.decisions().select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept").collect()
    return sorted((tuple(r)[:4] for r in rows), key=str), sum(r.kept for r in rows)


def land(spark, rows, folder, parts=1):
    spark.createDataFrame(rows, "doc_id long, text string, file string, digest int, _file long").repartition(parts).write.mode("append").parquet(folder)


def wide(pairs):
    return [(i, t, "x", 1, 2) for i, t in pairs]


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / f"home-{uuid.uuid4().hex}")


def test_state_goes_on_with_new_files(spark, edge_rows, folders):
    source, home = folders
    first = [(r[0], r[1]) for r in edge_rows]
    land(spark, wide(first), source, 3)
    d = Deduplicator(spark, source, home, files_per_batch=1)
    d.ingest()
    assert found(d) == brute(first)
    second = [(900, "ONE"), (901, "One"), (902, "ΑΣ"), (903, "ας"), (None, "only"), (None, "only"), (904, None), (2, "x" * 3_000_000), (3, "x" * 3_000_000)]
    land(spark, wide(second), source, 2)
    again = Deduplicator(spark, source, home, files_per_batch=1)  # a new start from the checkpoints
    again.ingest()
    assert found(again) == brute(first + second)
    again.ingest()  # nothing new: nothing counted twice
    assert found(again) == brute(first + second)


def test_equal_digests_of_different_texts_are_told_apart(spark, edge_rows, folders):
    source, home = folders
    pairs = [(r[0], r[1]) for r in edge_rows] + [(1000 + k, f"text {k % 40}") for k in range(200)]
    land(spark, wide(pairs), source, 4)
    d = Deduplicator(spark, source, home, digest=lambda t: F.encode((F.crc32(t) % 3).cast("string"), "utf-8"))
    d.ingest()
    rows, kept = found(d)
    want, n = brute(pairs)
    assert sorted((r[:3] for r in rows), key=str) == sorted((r[:3] for r in want), key=str)
    assert kept == n


def test_one_hot_group_and_more_copies_than_a_share(spark, folders):
    source, home = folders
    pairs = [(k, "Same TEXT") for k in range(2500)] + [(k, f"text {k // 2}") for k in range(2500, 4000)]
    land(spark, wide(pairs), source, 5)
    d = Deduplicator(spark, source, home)
    d.ingest()
    assert found(d) == brute(pairs)


def test_single_file_and_empty_table(spark, folders, no_docs):
    source, home = folders
    no_docs.coalesce(1).write.parquet(source)
    d = Deduplicator(spark, source, home)
    d.ingest()
    assert found(d) == ([], 0)
    land(spark, wide([(1, "a"), (2, "A")]), source + "2")
    file = next(f"{source}2/{f}" for f in os.listdir(source + "2") if f.endswith(".parquet"))
    d = Deduplicator(spark, file, home + "2")
    d.ingest()
    assert found(d) == brute([(1, "a"), (2, "A")])


def test_changed_files_are_an_error(spark, folders):
    source, home = folders
    land(spark, wide([(1, "a"), (2, "A")]), source)
    d = Deduplicator(spark, source, home)
    d.ingest()
    land(spark, wide([(1, "a")]), source + "-other")
    d.source = source + "-other"
    with pytest.raises(ValueError, match="changed"):
        d.decisions()


def test_no_python_in_the_plan(spark, folders):
    source, home = folders
    land(spark, wide([(1, "a"), (2, "A"), (3, "b")]), source)
    d = Deduplicator(spark, source, home)
    d.ingest()
    plan = d._counted()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
