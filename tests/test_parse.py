import datetime as dt

import pytest
from pyspark.sql import functions as F

from saiflow.operators import html
from saiflow.operators import parse as P

FORUM_PAGE = """<html><body><div id="articlelistnew">
<div class="articleh normal_post"><span class="l3 a3"><a href="/news,1.html" title="牛市来了，他来了！">牛市来了</a></span>
<span class="l4 a4"><a href="/u/1"><font>老股民</font></a></span><span class="l5 a5">01-05 10:31</span></div>
<div class="articleh normal_post"><span class="l3 a3"><a href="/news,2.html">无标题属性</a></span>
<span class="l4 a4"><a href="/u/2"><font>匿名</font></a></span><span class="l5 a5">01-05 10:20</span></div>
<div class="articleh normal_post"><span class="l3 a3"><a href="/news,3.html" title="下跌中继">x</a></span>
<span class="l4 a4">
  <font color="red">东方资讯</font></span><span class="l5 a5">1-4 9:05</span></div>
</div></body></html>"""


def test_parse_forum_page(spark):
    pages = spark.createDataFrame([(1, "zssh000001", FORUM_PAGE), (2, "zssh000001", "<html>nothing</html>")],
                                  "page_no int, code string, html string")
    rows = P.parse_forum_page(pages, 2024, keep=["page_no"]).orderBy("pos").collect()
    assert [(r.pos, r.title, r.author) for r in rows] == [(0, "牛市来了，他来了！", "老股民"), (2, "下跌中继", "东方资讯")]
    assert rows[0].dtime == dt.datetime(2024, 1, 5, 10, 31)
    assert rows[1].dtime == dt.datetime(2024, 1, 4, 9, 5)


def test_parse_post_time_edges(spark):
    df = spark.createDataFrame([("02-29 10:00", 2023), ("02-29 10:00", 2024), ("1-2 3:04", 2024), ("bad", 2024)],
                               "t string, y int")
    got = [r.ts for r in df.select(P.parse_post_time("t", F.col("y")).alias("ts")).collect()]
    assert got == [None, dt.datetime(2024, 2, 29, 10, 0), dt.datetime(2024, 1, 2, 3, 4), None]


def test_sector_links_and_enum(spark):
    html = '<div class="cate_inner"><a href="http://q.x.cn/thshy/detail/code/881101/">种植业与林业</a>' \
           '<a href="/ab/">短</a></div>'
    df = spark.createDataFrame([(html,)], "html string")
    rows = P.extract_sector_links(df, "20230901").orderBy("pos").collect()
    assert [(r.bk_code, r.bk_name, r.bk_type, r.use_flag) for r in rows] == [
        ("881101", "种植业与林业", "行业板块", 0), ("/ab", "短", "行业板块", 0)]
    with pytest.raises(ValueError):
        P.extract_sector_links(df, "20230901", "bad")


def test_strided_rows(spark):
    df = spark.createDataFrame([(1, ["600000", "浦发银行", "600036", "招商银行", "600999"]), (2, [])],
                               "k int, a array<string>")
    pairs = P.strided_rows(df, "a", 2, keep=["k"]).orderBy("idx").collect()
    assert [(r.idx, r.code, r.name) for r in pairs] == [(0, "600000", "浦发银行"), (1, "600036", "招商银行")]
    triples = P.strided_rows(df, "a", 3, keep=["k"]).orderBy("idx").collect()
    assert [(r.code, r.name) for r in triples] == [("600000", "浦发银行"), ("招商银行", "600999")]
    one_tail = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "k int, a array<string>")
    assert [(r.code, r.name) for r in P.strided_rows(one_tail, "a", 3).collect()] == [("a", "b")]


def test_parse_bars_edges(spark):
    bodies = [
        ("881101", 'quotebridge({"data":"20170103,3377.61,3443.5,3375.48,3443.5,274943000,3716640000,x;'
                   '20170104,3460.55,3485.34,3450.91,3483.28,274666000,3556330000;20170105,1,2\n"})'),
        ("881102", "no payload here"), ("881103", '({"data":""})'), ("881104", '({"data":"20170103,,1,1,1,1,1"})'),
        (None, '({"data":"20170103,1,1,1,1,1,1"})'), ("881105", None), ("881106", '({"data":"2017-01-3,1,1,1,1,1,1;20170230,1,1,1,1,1,1;bad"})'),
    ]
    df = spark.createDataFrame(bodies, "bk_code string, body string")
    good = {(r.bk_code, r.trade_date): r for r in P.parse_bars(df).collect()}
    assert set(good) == {("881101", "20170103"), ("881101", "20170104")}
    r = good[("881101", "20170103")]
    assert (r.open, r.close, r.amount) == (3377.61, 3443.5, 3716640000.0)
    bad = sorted((r.bk_code or "", r.reason) for r in P.parse_bars(df, with_rejects=True).collect() if r.reason)
    assert bad == [("", "no_code"), ("881101", "ragged"), ("881102", "no_payload"), ("881104", "bad_number"), ("881105", "no_payload"),
                   ("881106", "bad_date"), ("881106", "bad_date"), ("881106", "ragged")]


def test_page_items(spark):
    df = spark.createDataFrame([(1, "<title>T &amp; U</title><script>'<p>no</p>'</script><h1>H</h1><p class=x>a<b>x</b> y<p>b</p>"), (2, None)], "id int, html string")
    got = [(r.kind, r.text) for r in P.extract_page_items(df, keep=["id"]).orderBy("pos").collect()]
    assert got == [("title", "T & U"), ("h1", "H"), ("p", "ax y"), ("p", "b")]


def test_forum_markup_as_browsers_read_it(spark):
    page = """<div id=articlelistnew><div class='x normal_post'><span class="l3 a3"><em>!</em><a class=q href='/n' title='A&amp;B &quot;q&quot; &#36;'>s</a></span>
<span class='l4 a4'><font> u <b>v</b> </font></span><span class="l5 a5"> 01-05 10:31 </span></div><div class=normal_post></div></div>
<div class="normal_post"><span class="l3 a3"><a title="outside">x</a></span></div>"""
    rows = P.parse_forum_page(spark.createDataFrame([(page,)], "html string"), 2024).collect()
    assert [(r.title, r.author, r.dtime) for r in rows] == [('A&B "q" $', " u v ", dt.datetime(2024, 1, 5, 10, 31))]


def test_constituents(spark):
    page = '<nav><a target="_blank">no</a></nav><div class="body m-pager-box"><table><tbody><tr><td><a href="/c" target="_blank">600000</a></td>' \
           '<td><a target="_blank">浦发&amp;银行</a></td><td><a>+</a></td></tr></tbody></table></div>'
    df = spark.createDataFrame([("k", page), ("none", "<p>x</p>"), ("null", None)], "bk_code string, html string")
    assert [tuple(r) for r in P.extract_constituents(df, keep=["bk_code"]).collect()] == [("k", 0, "600000", "浦发&银行")]
    pairs = P.extract_constituents(spark.createDataFrame([("<a target=_blank>1</a><a>no</a><a x='' target='_blank'>n</a>",)], "html string"), dynamic=False)
    assert [(r.code, r.name) for r in pairs.collect()] == [("1", "n")]


def test_post_year_from_fetch(spark):
    df = spark.createDataFrame([("12-31 10:00", dt.datetime(2024, 1, 2, 8, 0)), ("01-02 07:00", dt.datetime(2024, 1, 2, 8, 0)),
                                ("01-20 07:00", dt.datetime(2024, 1, 5, 8, 0)), ("02-29 07:00", dt.datetime(2025, 1, 5, 8, 0))],
                               "t string, f timestamp_ntz")
    rows = df.select(P.parse_post_time("t", P.post_year_from_fetch("t", "f")).alias("ts")).collect()
    assert [r.ts for r in rows] == [dt.datetime(2023, 12, 31, 10, 0), dt.datetime(2024, 1, 2, 7, 0),
                                    dt.datetime(2023, 1, 20, 7, 0), dt.datetime(2024, 2, 29, 7, 0)]


def test_results_of_a_task_are_not_held_together(spark):
    class Found(list):
        live = 0

        def __init__(self):
            Found.live += 1
            super().__init__([{"n": Found.live}])

        def __del__(self):
            Found.live -= 1

    pages = spark.range(0, 2000, 1, 1).select("id", F.lit("<p>x</p>").alias("html"))
    found = pages.select("id", html.column(lambda page: Found(), "array<struct<n:int>>", "html").alias("f")).select("id", F.inline("f"))
    top = found.agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    assert top.rows == 2000 and top.n <= 200
