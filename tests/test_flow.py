"""The README's library example, end to end on a tiny landed page."""
import datetime as dt
import math
import uuid

from saiflow import schemas
from saiflow.operators import clean, index, labels, load
from test_stream import PAGE


def test_readme_flow(spark, tmp_path):
    root = str(tmp_path)
    fetched = dt.datetime(2024, 1, 3, 18, 0)
    pages = spark.createDataFrame([(1, "600999", "u", PAGE.format(t1="牛市来了", a1="甲", d1="01-02 10:00",
                                                                   t2="奥福环保大涨", a2="乙", d2="01-02 10:30"), fetched)],
                                  schemas.RAW_PAGES)
    names = spark.createDataFrame([(1, "奥福环保"), (2, "天奈科技")], "ord long, name string")
    assert load.ingest_pages(spark, pages, f"{root}/posts", name_grams=clean.name_grams(names)) == 1   # advert dropped
    posts = spark.read.parquet(f"{root}/posts")
    cons = spark.createDataFrame([("881101", "600999", "x")], "bk_code string, code string, name string")
    sai = index.sector_attention(posts.selectExpr("code", "cast(dtime as date) trade_date"), cons, period="day",
                                 calendar=spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),)], "trade_date date"))
    assert [(r.bk_code, r.period, r.n_posts) for r in sai.collect()] == [("881101", dt.date(2024, 1, 2), 1)]
    mood = index.sentiment_attention(labels.lexicon_label(posts).selectExpr("code", "to_date(dtime) day", "label")).first()
    assert (mood.n_call, mood.n_put, mood.bullish) == (1, 0, math.log(2))
    quotes = spark.createDataFrame([("881101", '({"data":"20240102,1,2,0.5,1.5,10,100"})')], "bk_code string, body string")
    load.load_bars(spark, quotes, f"{root}/bars", run_id=uuid.uuid4().hex)
    assert spark.read.parquet(f"{root}/bars").count() == 1
