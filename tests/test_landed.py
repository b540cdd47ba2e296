"""Landed files and bucketed catalog tables."""
import datetime as dt
import gzip
import uuid

import pytest
from pyspark.sql import functions as F

from frames import posts_df
from saiflow import schemas
from saiflow.sources import landed as L
from saiflow.sources import tables as T

PATTERN = (r"list,([a-z0-9]+),f_", r"f_(\d+)\.")


def _pages(folder):
    folder.mkdir()
    chinese = "<meta charset='gb2312'><p>股吧 首页</p>"
    files = {"list,zssh000001,f_1.html": "<p>plain é</p>".encode(), "list,zssh000001,f_2.html.gz": gzip.compress(chinese.encode("gb18030")),
             "list,600999,f_3.html.gz": gzip.compress(b"<p>cut short</p>" * 50)[:-30], "list,600999,f_4.html": b"\xff\xfe" + "宽".encode("utf-16-le"),
             "list,600999,f_5.html": b"<meta charset=nosuch>", "list,600999,f_6.html": b"\xffbad", "other.html": b"", "list,600999,f_7.gz":
             gzip.compress(b"two ") + gzip.compress(b"members")}
    for name, raw in files.items():
        (folder / name).write_bytes(raw)
    return chinese


def test_a_folder_gives_pages_and_rejects(spark, tmp_path):
    chinese = _pages(tmp_path / "in")
    good, bad = L.split_rejects(L.landed_responses(spark, str(tmp_path / "in"), *PATTERN))
    assert good.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.RAW_PAGES]
    assert sorted((r.page_no, r.code, r.html) for r in good.collect()) == [
        (1, "zssh000001", "<p>plain é</p>"), (2, "zssh000001", chinese), (4, "600999", "宽"), (7, "600999", "two members")]
    assert sorted((r.url.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [
        ("list,600999,f_3.html.gz", "bad_gzip"), ("list,600999,f_5.html", "bad_charset"), ("list,600999,f_6.html", "bad_text")]
    assert all(r.fetched_at.year >= 2024 for r in good.collect())


def test_a_stream_of_the_folder_gives_the_same(spark, tmp_path):
    _pages(tmp_path / "in")
    stream = L.landed_responses(spark, str(tmp_path / "in"), *PATTERN, stream=True, max_files_per_trigger=3)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), L.landed_responses(spark, str(tmp_path / "in"), *PATTERN)
    assert got.count() == 7 and got.exceptAll(want).count() == 0


def test_landed_pages_reach_the_post_table(spark, tmp_path):
    from saiflow.operators.load import ingest_pages

    page = ('<div id="articlelistnew"><div class="articleh normal_post"><span class="l3 a3"><a title="第一帖">x</a></span>'
            '<span class="l4 a4"><a><font>甲</font></a></span><span class="l5 a5">01-02 10:30</span></div></div>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "list,zssh000001,f_1.html.gz").write_bytes(gzip.compress(page.encode()))
    good, _ = L.split_rejects(L.landed_responses(spark, str(tmp_path / "in"), *PATTERN))
    assert ingest_pages(spark, good, str(tmp_path / "posts"), year=2024) == 1
    row = spark.read.parquet(str(tmp_path / "posts")).first()
    assert (row.code, row.dtime, row.title, row.author) == ("zssh000001", dt.datetime(2024, 1, 2, 10, 30), "第一帖", "甲")


def test_too_long_a_response():
    assert L.decode_response(b"") == L.decode_response(None) == (None, "empty")
    assert L.decode_response(gzip.compress(b"x" * 1000), most=999) == (None, "too_long")
    assert L.decode_response(gzip.compress(b"x" * 1000), most=1000)[0] == "x" * 1000


@pytest.fixture
def table(spark, tmp_path):
    name = f"posts_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"drop table if exists {name}")


def test_the_stored_side_is_not_shuffled(spark, tmp_path, table):
    stored = posts_df(spark, [("A", f"2024-01-0{1 + k % 9} 10:00:00", f"t{k}", "u") for k in range(50)])
    T.create_bucketed(stored, table, buckets=4, path=str(tmp_path / "t"))
    new = posts_df(spark, [("A", f"2024-01-0{1 + k % 9} 10:00:00", f"t{k}", "u") for k in range(40, 60)] * 2 + [("A", None, "x", "u"), (None, "2024-01-01 10:00:00", "x", "u")])
    rows = T.absent_from_table(spark, new, table)
    assert sorted(r.title for r in rows.collect()) == [f"t{k}" for k in range(50, 60)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = T.absent_from_table(spark, new, table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # of the new rows alone
    T.append_absent(spark, new, table, buckets=4)
    T.append_absent(spark, new, table, buckets=4)
    assert spark.table(table).count() == 60
    with pytest.raises(ValueError, match="extra"):
        T.append_absent(spark, new.withColumn("extra", F.lit(1)), table, buckets=4)
