import datetime as dt
import uuid

from pyspark.sql import functions as F

from saiflow import schemas
from saiflow.operators.aggregate import daily_post_volume
from saiflow.operators.clean import clean_posts
from saiflow.operators.load import dedup_posts
from saiflow.plans.fixtures import Views
from saiflow.streaming import stream as S

SF = "/root/testdata/sf0.001"


def _land(spark, root):
    """Land the events-as-posts stand-in as three files, with one file repeated."""
    posts = Views(spark, SF).posts_ev().select(*schemas.POST_KEYS)
    a = posts.where(F.col("dtime") < "2024-01-11")
    b = posts.where((F.col("dtime") >= "2024-01-11") & (F.col("dtime") < "2024-01-21"))
    c = posts.where(F.col("dtime") >= "2024-01-21")
    for i, part in enumerate([a, b, c, b]):
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/landing/batch={i}")
    return posts


def test_stream_dedup_load_matches_batch_and_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    posts = _land(spark, root)
    landing, target = f"{root}/landing", f"{root}/posts"
    q = S.start_dedup_load(spark, landing, target, name=f"t1-{uuid.uuid4().hex}")
    q.awaitTermination()
    got = spark.read.parquet(target).drop("day")
    want = dedup_posts(clean_posts(posts))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    # a second run over the same files (new checkpoint) appends nothing
    q2 = S.start_dedup_load(spark, landing, target, name=f"t1b-{uuid.uuid4().hex}")
    q2.awaitTermination()
    assert spark.read.parquet(target).count() == want.count()
    assert {r.day for r in spark.read.parquet(target).select("day").distinct().collect()} == \
        {r.d for r in want.select(F.to_date("dtime").alias("d")).distinct().collect()}


def test_late_same_day_and_replayed_posts_count_once(spark, tmp_path):
    """A late post, a post of a stored day and a replay are each in the table and the daily count once."""
    root = str(tmp_path)
    mk = lambda rows: spark.createDataFrame(
        [("A", dt.datetime.fromisoformat(t), ti, "u") for t, ti in rows], schemas.POSTS)
    name = f"t2-{uuid.uuid4().hex}"

    def run(name):
        S.start_daily_volume(spark, f"{root}/land/*", f"{root}/posts", f"{root}/daily", name=name).awaitTermination()
        return {(str(r.trade_date), r.n_posts) for r in spark.read.parquet(f"{root}/daily").collect()}

    mk([("2024-01-02 10:00:00", "a"), ("2024-01-10 10:00:00", "b"), ("2024-01-10 10:00:00", "b")]).write.parquet(f"{root}/land/f1")
    assert run(name) == {("2024-01-02", 1), ("2024-01-10", 1)}
    mk([("2024-01-02 11:00:00", "late"), ("2024-01-10 11:00:00", "same day"), ("2024-01-11 10:00:00", "c"),
        ("2024-01-10 10:00:00", "b")]).write.parquet(f"{root}/land/f2")
    want = {("2024-01-02", 2), ("2024-01-10", 2), ("2024-01-11", 1)}
    assert run(name) == want
    assert run(f"{name}-replay") == want          # a new checkpoint reads all files again
    assert spark.read.parquet(f"{root}/posts").count() == 5


def test_stream_daily_volume_matches_batch(spark, tmp_path):
    root = str(tmp_path)
    posts = _land(spark, root)
    S.start_daily_volume(spark, f"{root}/landing", f"{root}/posts", f"{root}/daily", name=f"t2-{uuid.uuid4().hex}").awaitTermination()
    got = spark.read.parquet(f"{root}/daily").select("code", "trade_date", "n_posts")
    want = daily_post_volume(dedup_posts(clean_posts(posts)))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


PAGE = """<div id="articlelistnew">
<div class="articleh normal_post"><span class="l3 a3"><a href="/n/1" title="{t1}">x</a></span>
<span class="l4 a4"><a href="/u"><font>{a1}</font></a></span><span class="l5 a5">{d1}</span></div>
<div class="articleh normal_post"><span class="l3 a3"><a href="/n/2" title="{t2}">x</a></span>
<span class="l4 a4"><a href="/u"><font>{a2}</font></a></span><span class="l5 a5">{d2}</span></div></div>"""


def test_page_stream_and_batch_ingest_agree(spark, tmp_path):
    from saiflow.operators.load import ingest_pages
    root = str(tmp_path)
    fetched = dt.datetime(2024, 1, 3, 18, 0)
    rows = [(3, "zssh000001", "u3", PAGE.format(t1="无时间", a1="甲", d1="soon", t2="新年帖", a2="乙", d2="01-02 10:30"), fetched),
            (1, "zssh000001", "u1", PAGE.format(t1="跨年帖", a1="甲", d1="12-31 10:00", t2="新年帖", a2="乙", d2="01-02 10:30"), fetched),
            (2, "zssh000001", "u2", PAGE.format(t1="新年帖", a1="乙", d1="01-02 10:30", t2="$公告", a2="丙", d2="01-02 11:00"), fetched)]
    pages = spark.createDataFrame(rows, schemas.RAW_PAGES)
    pages.write.parquet(f"{root}/pages")
    q = S.start_dedup_load(spark, f"{root}/pages", f"{root}/stream_posts", name=f"pg-{uuid.uuid4().hex}",
                           pages=True, rejects=f"{root}/stream_rejects")
    q.awaitTermination()
    assert ingest_pages(spark, pages, f"{root}/batch_posts", rejects=f"{root}/rejects") == 2
    for table in ("rejects", "stream_rejects"):
        assert [(r.time_text, r.title) for r in spark.read.parquet(f"{root}/{table}").collect()] == [("soon", "无时间")]
    s_rows = sorted((r.dtime, r.title) for r in spark.read.parquet(f"{root}/stream_posts").collect())
    b_rows = sorted((r.dtime, r.title) for r in spark.read.parquet(f"{root}/batch_posts").collect())
    assert s_rows == b_rows == [(dt.datetime(2023, 12, 31, 10, 0), "跨年帖"), (dt.datetime(2024, 1, 2, 10, 30), "新年帖")]


def _posts(spark, rows):
    return spark.createDataFrame([("A", dt.datetime.fromisoformat(t), ti, "u") for t, ti in rows], schemas.POSTS)


def test_event_time_load_equals_batch_with_replayed_and_late_posts(spark, tmp_path):
    root, name = str(tmp_path), uuid.uuid4().hex
    landed = []

    def land_and_run(k, rows, suffix=""):
        if rows:
            _posts(spark, rows).coalesce(1).write.parquet(f"{root}/land/f{k}")
            landed.extend(rows)
        S.start_watermark_dedup(spark, f"{root}/land/*", f"{root}/posts", "2 days", f"w-{name}{suffix}").awaitTermination()
        S.start_late_load(spark, f"{root}/land/*", f"{root}/posts", f"{root}/seen", "2 days", f"l-{name}{suffix}").awaitTermination()
        got = spark.read.parquet(f"{root}/posts").select(*schemas.POST_KEYS)
        want = dedup_posts(clean_posts(_posts(spark, landed)))
        assert got.count() == want.count() and got.exceptAll(want).count() == 0

    land_and_run(1, [("2024-01-02 10:00:00", "a"), ("2024-01-02 10:00:00", "a"), ("2024-01-10 10:00:00", "b")])
    # days late, a repeat of a stored post that the state has given up, one in time, a repeat in time
    land_and_run(2, [("2024-01-02 11:00:00", "late"), ("2024-01-02 10:00:00", "a"), ("2024-01-09 10:00:00", "c"), ("2024-01-10 10:00:00", "b")])
    land_and_run(3, [("2024-01-20 10:00:00", "d"), ("2024-01-02 11:00:00", "late"), ("2024-01-03 11:00:00", "later"), ("2024-01-20 10:00:00", "")])
    land_and_run(4, [])  # nothing new


def test_windowed_volume_goes_on_after_a_restart(spark, tmp_path):
    root, name = str(tmp_path), f"v-{uuid.uuid4().hex}"
    posts = Views(spark, SF).posts_ev().select(*schemas.POST_KEYS)
    for k, days in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-12"), ("2024-01-12", "2024-02-01")]):
        part = posts.where((F.col("dtime") >= days[0]) & (F.col("dtime") < days[1])).repartition(2)
        part.write.parquet(f"{root}/land/f{k}")
        # half of a day comes with the next start: its count goes on from the state
        extra = posts.where(F.to_date("dtime") == days[0])
        extra.write.parquet(f"{root}/land/e{k}")
        S.start_windowed_volume(spark, f"{root}/land/*", f"{root}/counts", "40 days", name).awaitTermination()
        got = S.windowed_volume(spark, f"{root}/counts").select("code", "trade_date", "n_posts")
        want = daily_post_volume(spark.read.schema(schemas.POSTS).parquet(f"{root}/land/*"))
        assert got.count() == want.count() and got.exceptAll(want.select("code", "trade_date", "n_posts")).count() == 0
