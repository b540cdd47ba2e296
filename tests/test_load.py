import os
import uuid

import pytest
from pyspark.sql import functions as F

from frames import posts_df
from saiflow import schemas
from saiflow.operators import load as D
from saiflow.session import ensure_checkpoint_dir

NEW = [
    ("zssh000001", "2024-01-05 10:00:00", "c", "u3"),
    ("zssh000001", "2024-01-05 09:30:00", "b", "u2"),
    ("zssh000001", "2024-01-05 09:30:00", "b", "u2"),   # exact repeat
    ("zssh000001", "2024-01-04 11:00:00", "a", "u1"),   # already stored
    ("zssh000001", "2024-01-04 10:00:00", "z", "u9"),   # new, after the conflict
]


def test_dedup_and_insert_if_absent(spark):
    new = posts_df(spark, NEW)
    stored = posts_df(spark, [NEW[3]])
    assert D.dedup_posts(new).count() == 4
    got = sorted(r.title for r in D.insert_if_absent(new, stored).collect())
    assert got == ["b", "c", "z"]


def test_append_until_conflict(spark):
    new = posts_df(spark, NEW).withColumn("pos", F.monotonically_increasing_id())
    stored = posts_df(spark, [NEW[3]])
    got = sorted(r.title for r in D.append_until_conflict(new, stored, "pos").collect())
    assert got == ["b", "c"]       # the insert stops at the stored row; "z" after it is not written
    none_stored = spark.createDataFrame([], schemas.POSTS)
    assert D.append_until_conflict(new, none_stored, "pos").count() == 4


def test_load_twice_equals_once(spark, tmp_path):
    path = str(tmp_path / "posts")
    new = posts_df(spark, NEW)
    assert D.load_posts(spark, new, path) == 4
    assert D.load_posts(spark, new, path) == 0
    assert spark.read.parquet(path).count() == 4


def test_union_then_dedup_equals_dedup_of_union(spark):
    a, b = posts_df(spark, NEW[:3]), posts_df(spark, NEW[2:])
    u = D.dedup_posts(D.union_batches(a, b))
    assert sorted(map(tuple, u.collect())) == sorted(map(tuple, D.dedup_posts(posts_df(spark, NEW)).collect()))


def test_incremental_backfill(spark):
    stored = posts_df(spark, [("A", "2024-01-04 11:00:00", "old", "u")])
    new = posts_df(spark, [
        ("A", "2024-01-04 15:00:00", "same day as stored", "u"),
        ("A", "2024-01-05 10:00:00", "next day", "u"),
        ("A", "2024-01-05 08:00:00", "before session", "u"),
        ("B", "2024-01-02 10:00:00", "nothing stored for B", "u"),
        ("B", "2023-12-29 10:00:00", "other year", "u"),
    ])
    got = sorted(r.title for r in D.incremental_backfill(new, stored, 2024).collect())
    assert got == ["next day", "nothing stored for B", "same day as stored"]
    assert D.incremental_backfill(new, new, 2024).count() == 0


def bars(spark, rows):
    return spark.createDataFrame(rows, schemas.SECTOR_DAILY).withColumn("seq", F.monotonically_increasing_id())


def test_upsert_bars_partition_overwrite(spark, tmp_path):
    path, staged = str(tmp_path / "bars"), ensure_checkpoint_dir(spark)
    first = bars(spark, [("881101", "20230103", 1.0, 2.0, 0.5, 1.5, 10.0, 100.0), ("881101", "20220103", 1.0, 2.0, 0.5, 1.5, 10.0, 100.0)])
    D.upsert_bars_to_path(spark, first, path, uuid.uuid4().hex, "seq")
    again = bars(spark, [("881101", "20230103", 1.0, 2.0, 0.5, 9.9, 10.0, 100.0), ("881101", "20230104", 1.0, 2.0, 0.5, 1.6, 10.0, 3716640000.0)])
    D.upsert_bars_to_path(spark, again, path, uuid.uuid4().hex, "seq")
    rows = {(r.trade_date): r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"20220103", "20230103", "20230104"}
    assert rows["20230103"].close == 9.9
    assert rows["20230104"].amount == 3716640000.0     # above 2^24, kept exact as DOUBLE
    D.upsert_bars_to_path(spark, again, path, uuid.uuid4().hex, "seq")  # replay: same table
    assert spark.read.parquet(path).count() == 3
    assert not any(n.startswith("stage-bars") for n in os.listdir(staged.removeprefix("file:")))


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    """Duplicates and null keys, on the first load and on a later one."""
    path = str(tmp_path / "bars")
    rows = [("A", "20230103", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", "20230103", 2.0, 2.0, 2.0, 2.0, None, 2.0), (None, "20230103", 3.0, 3.0, 3.0, 3.0, 3.0, 3.0),
            ("A", None, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0), ("A", "n/a", 3.0, 3.0, 3.0, 3.0, 3.0, 3.0)]
    for _ in range(2):
        D.upsert_bars_to_path(spark, bars(spark, rows).coalesce(1), path, uuid.uuid4().hex, "seq")
        assert [(r.bk_code, r.trade_date, r.open, r.vol) for r in spark.read.parquet(path).collect()] == [("A", "20230103", 2.0, None)]


def test_writers_do_not_take_errors_for_a_first_load(spark, tmp_path):
    path = str(tmp_path / "bars")
    old = bars(spark, [("A", "20230103", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("B", "20230104", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    D.upsert_bars_to_path(spark, old, path, uuid.uuid4().hex, "seq")
    lacking = bars(spark, [("A", "20230103", 7.0, 1.0, 1.0, 1.0, 1.0, 1.0)]).drop("vol")
    D.upsert_bars_to_path(spark, lacking, path, uuid.uuid4().hex, "seq")   # a lacking column is NULL, stored rows stay
    assert sorted((r.bk_code, r.open, r.vol) for r in spark.read.parquet(path).collect()) == [("A", 7.0, None), ("B", 1.0, 1.0)]
    with pytest.raises(ValueError):
        D.upsert_bars_to_path(spark, old.withColumn("extra", F.lit(1)), path, uuid.uuid4().hex, "seq")
    broken = tmp_path / "broken"
    (broken / "day=2024-01-05").mkdir(parents=True)
    (broken / "day=2024-01-05" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        D.load_posts(spark, posts_df(spark, NEW), str(broken))
    assert [p.name for p in broken.rglob("*.parquet")] == ["part-0.parquet"]
    assert spark.read.parquet(path).count() == 2


def test_posts_twice_in_one_table_only_once(spark, tmp_path):
    path = str(tmp_path / "posts")
    assert D.load_posts(spark, posts_df(spark, []), path) == 0
    assert D.load_posts(spark, posts_df(spark, NEW[:2]), path) == 2
    assert D.load_posts(spark, posts_df(spark, NEW), path) == 2
    assert spark.read.parquet(path).count() == 4


def test_rejects_are_kept_by_run(spark, tmp_path):
    path, rejects = str(tmp_path / "bars"), str(tmp_path / "rejects")
    payloads = spark.createDataFrame([("A", '({"data":"20230103,1,1,1,1,1,1;bad;20230104,1,x,1,1,1,1"})'), (None, '({"data":"20230103,1,1,1,1,1,1"})')],
                                     "bk_code string, body string")
    for run in ("r1", "r1", "r2"):
        D.load_bars(spark, payloads, path, run, rejects)
    assert spark.read.parquet(path).count() == 1
    got = sorted((r.run_id, r.bk_code or "", r.reason) for r in spark.read.parquet(rejects).collect())
    assert got == [(run, c, why) for run in ("r1", "r2") for c, why in (("", "no_code"), ("A", "bad_number"), ("A", "ragged"))]


def test_load_prunes_stored_days(spark, tmp_path):
    """Only the partitions of the batch's days are scanned (dynamic pruning)."""
    path = str(tmp_path / "posts_by_day")
    days = [(f"c{i}", f"2024-01-{d:02d} 10:00:00", f"t{d}", "u") for d in range(1, 11) for i in range(3)]
    D.load_posts(spark, posts_df(spark, days), path)
    batch = posts_df(spark, [("c0", "2024-01-10 11:00:00", "new", "u"), ("c0", "2024-01-10 10:00:00", "t10", "u")])
    batch = batch.withColumn("day", F.to_date("dtime"))
    target = D.stored_days(spark.read.parquet(path), batch)
    target.write.format("noop").mode("overwrite").save()
    plan = target._jdf.queryExecution().executedPlan().toString()
    scans = [ln.split("PartitionFilters: ")[1] for ln in plan.splitlines() if "PartitionFilters: [isnotnull(day" in ln]
    assert scans and all("Subquery" in s for s in scans)
    assert target.count() == 3
    assert D.load_posts(spark, batch.drop("day"), path) == 1


def test_load_bars_from_payloads(spark, tmp_path):
    payloads = spark.createDataFrame([
        ("881101", '({"data":"20170103,3377.61,3443.5,3375.48,3443.5,274943000,3716640000;'
                   '20180104,3460.55,3485.34,3450.91,3483.28,274666000,3556330000"})')], "bk_code string, body string")
    path = str(tmp_path / "bars")
    D.load_bars(spark, payloads, path, uuid.uuid4().hex)
    D.load_bars(spark, payloads, path, uuid.uuid4().hex)      # nightly rerun: same table
    rows = spark.read.parquet(path).orderBy("trade_date").collect()
    assert [(r.trade_date, r.year, r.close) for r in rows] == [("20170103", 2017, 3443.5), ("20180104", 2018, 3483.28)]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_POST = st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 3), st.sampled_from(["t1", "t2"]), st.sampled_from(["u", "v"]))


@settings(max_examples=6, deadline=None)
@given(st.lists(_POST, max_size=12), st.lists(_POST, max_size=12))
def test_union_dedup_property(spark_session_holder, a, b):
    spark = spark_session_holder
    mk = lambda rows: posts_df(spark, [(c, f"2024-01-0{d + 1} 10:00:00", t, u) for c, d, t, u in rows])
    got = D.dedup_posts(D.union_batches(mk(a), mk(b)))
    want = D.dedup_posts(mk(a + b))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(
        map(tuple, posts_df(spark, sorted({(c, f"2024-01-0{d + 1} 10:00:00", t, u) for c, d, t, u in a + b})).collect()))


def test_dedup_keeps_first_by_order(spark):
    df = spark.createDataFrame([("k", 3, "late"), ("k", 1, "first"), ("j", 2, "only")], "code string, pos int, note string")
    got = {r.code: r.note for r in D.dedup_posts(df, ["code"], order_col="pos").collect()}
    assert got == {"k": "first", "j": "only"}


def test_case_insensitive_keys_option(spark):
    new = posts_df(spark, [("A", "2024-01-02 10:00:00", "Bull Run", "u"), ("A", "2024-01-02 10:00:00", "bull run", "u"),
                           ("A", "2024-01-02 11:00:00", "NEW", "u")])
    stored = posts_df(spark, [("A", "2024-01-02 11:00:00", "new", "u")])
    assert D.insert_if_absent(new, stored).count() == 3                       # binary keys (default)
    rows = D.insert_if_absent(new, stored, collation="UTF8_LCASE").collect()    # database-like keys
    assert len(rows) == 1 and rows[0].title.lower() == "bull run"
    assert dict(D.insert_if_absent(new, stored, collation="UTF8_LCASE").dtypes)["title"] == "string"


def test_with_code_names_the_posts(spark):
    """A crawl of one board gets its code; dedup then counts a post of two boards twice."""
    crawl = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "b")], "title string, author string")
    both = D.with_code(crawl, "zssh000001").unionByName(D.with_code(crawl, "600999"))
    got = D.dedup_posts(both, ["code", "title", "author"])
    assert sorted(map(tuple, got.select("code", "title", "author").collect())) == [
        ("600999", "t", "a"), ("600999", "u", "b"), ("zssh000001", "t", "a"), ("zssh000001", "u", "b")]
