import datetime as dt

import pytest
from pyspark.sql import functions as F

from saiflow import sources
from saiflow.operators import aggregate as A


def test_posts_csv_header_replaced_and_codes_kept(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text("股票,时间,标题,作者\n000001,2024-01-02 10:00:00,\"标题, 含逗号\",张三\n600999,2024-01-02 11:00:00,x,y\n",
                 encoding="utf-8")
    rows = sources.read_posts_csv(spark, str(p)).orderBy("code").collect()
    assert [r.code for r in rows] == ["000001", "600999"]
    assert rows[0].title == "标题, 含逗号" and rows[0].dtime == dt.datetime(2024, 1, 2, 10, 0)


def test_sector_tsv_calendar_terms(spark, tmp_path):
    (tmp_path / "bk.txt").write_text("881101\t种植业与林业\n881102\t养殖业", encoding="utf-8")
    assert [tuple(r) for r in sources.read_sector_list(spark, str(tmp_path / "bk.txt")).collect()] == [
        ("881101", "种植业与林业"), ("881102", "养殖业")]
    (tmp_path / "cal.csv").write_text("2024-01-02\n2024-01-03\n", encoding="utf-8")
    cal = sources.read_calendar(spark, str(tmp_path / "cal.csv"))
    assert [r.trade_date for r in cal.collect()] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    (tmp_path / "terms.txt").write_text(" 跳水 \n\n\u3000快跑\t\n \t\n", encoding="utf-8")
    assert [r.term for r in sources.read_terms(spark, str(tmp_path / "terms.txt")).collect()] == ["跳水", "快跑"]


def test_tsv_sink_and_param_sql(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "author string, n_posts long")
    sources.write_tsv(df, str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1"), ("b", "2")]
    got = sources.param_sql(spark, "select author from {t} where n_posts > :k", {"k": 1}, t=df).collect()
    assert [r.author for r in got] == ["b"]


def test_param_sql_leaves_session_views(spark):
    spark.range(3).createOrReplaceTempView("mine")
    assert sources.param_sql(spark, "select count(*) n from {mine}", mine=spark.range(5)).first().n == 5
    assert spark.table("mine").count() == 3


def test_tsv_quotes_are_doubled(spark, tmp_path):
    sources.write_tsv(spark.createDataFrame([('a "b"\tc', "x")], "t string, u string"), str(tmp_path / "q"))
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    assert '"a ""b""\tc"\tx' in text


def test_posts_csv_splits_and_tells_bad_times(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text("a,b,c,d\n" + "600999,2024-01-02 11:00,x,y\n600999,soon,x,y\n" * 4000, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
        df = sources.read_posts_csv(spark, str(p), with_rejects=True)
        assert df.rdd.getNumPartitions() > 1
        assert df.where("dtime is null").select("time_text").distinct().collect()[0][0] == "soon"
        assert df.where("dtime is not null").count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_append_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.append_by_name(spark.range(2), path)
    sources.append_by_name(spark.range(2), path)
    with pytest.raises(ValueError):
        sources.append_by_name(spark.range(2).withColumn("x", F.lit(1)), path)
    with pytest.raises(ValueError):
        sources.jdbc_read(spark, "jdbc:none", "t")
    assert spark.read.parquet(path).count() == 4


def test_viewpoints_keep_order_and_nulls(spark):
    views = spark.createDataFrame([("2024-01-02", "x", 5), ("2024-01-02", "y", 1), ("2024-01-01", "z", 2),
                                   (None, "w", 3), ("2024-01-02", None, 4100), ("2024-01-03", "u", 7)], "dt string, viewpoint string, ord long")
    rows = A.viewpoints_by_day(views, "2024-01-02").orderBy("dt", "pos").collect()
    assert [tuple(r) for r in rows] == [("2024-01-02", 0, "y"), ("2024-01-02", 1, "x"), ("2024-01-02", 2, None), ("2024-01-03", 0, "u")]


def test_histogram_equal_values(spark):
    counts = spark.createDataFrame([(3,), (3,)], "n_posts long")
    rows = A.author_histogram(counts).where("n_authors > 0").collect()
    assert [(r.bin, r.left_edge, r.n_authors) for r in rows] == [(10, 3.0, 2)]


def test_scale_conf():
    from saiflow.session import scale_conf
    c = scale_conf(100 * 2**40, 1000, 8)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(2**30, 10, 4)["spark.sql.shuffle.partitions"] == "120"


def test_coverage_golden(spark):
    """Recorded check of the original load: 76 sectors; bars per sector of
    244, 243, 244, 243, 243, 242 for 2017-2022 and 163 for 2023."""
    from pyspark.sql import functions as F

    from saiflow.operators.market import coverage_check
    per_year = {2017: 244, 2018: 243, 2019: 244, 2020: 243, 2021: 243, 2022: 242, 2023: 163}
    import datetime as dt
    days = [(dt.date(y, 1, 1) + dt.timedelta(days=i)).strftime("%Y%m%d") for y, n in per_year.items() for i in range(n)]
    bars = spark.range(76).select((F.col("id") + 881101).cast("string").alias("bk_code"),
                                  F.explode(F.array(*[F.lit(d) for d in days])).alias("trade_date"))
    got = coverage_check(bars).groupBy("year").agg(F.count("bk_code").alias("sectors"), F.min("n_bars").alias("lo"),
                                                   F.max("n_bars").alias("hi")).collect()
    assert {(int(r.year), r.sectors, r.lo, r.hi) for r in got} == {(y, 76, n, n) for y, n in per_year.items()}


def test_read_viewpoints(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Dates,viewpoints\n2024-01-02,看多\n2024-01-02,\"看空, 回调\"\n", encoding="utf-8")
    df = sources.read_viewpoints(spark, str(tmp_path / "v.csv"))
    assert df.columns == ["dt", "viewpoint"]
    assert sorted(r.viewpoint for r in df.collect()) == sorted(["看多", "看空, 回调"])


def test_word_vectors_by_word_feed_the_similarity(spark, tmp_path):
    """Columns beyond word and vec are not read; the vectors serve the anchor similarity."""
    from saiflow.operators.text import anchor_similarity
    rows = [("up", [1.0, 0.0], "x"), ("high", [1.0, 1.0], "x"), ("down", [-1.0, 0.0], "x")]
    spark.createDataFrame(rows, "word string, vec array<float>, source string").write.parquet(str(tmp_path / "v"))
    vectors = sources.read_word_vectors(spark, str(tmp_path / "v"))
    assert vectors.columns == ["word", "vec"]
    words = spark.createDataFrame([(1, "high"), (1, "up"), (2, "down"), (3, "nowhere")], "post_id long, word string")
    assert [(r.post_id, r.similarity) for r in anchor_similarity(words, vectors, "up").collect()] == [(1, 0.854), (2, -1.0)]
