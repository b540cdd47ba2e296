
from saiflow.operators import text as N


def test_segmenter_and_stopwords(spark):
    df = spark.createDataFrame([(1, "南京证券绝对龙头 ok")], "ord long, title string")
    t = N.tokenize_posts(df, dictionary=["南京", "证券", "龙头", "绝对"])
    assert t.first().tokens == ["南京", "证券", "绝对", "龙头", "ok"]
    # intended: whole-token match; literal: first character only
    assert N.remove_stopwords(t, ["证券", "ok"]).first().tokens == ["南京", "绝对", "龙头"]
    assert N.remove_stopwords(t, ["证券", "龙"], first_char=True).first().tokens == ["南京", "证券", "绝对", "ok"]


def test_pad_sequence(spark):
    df = spark.createDataFrame([("ab",), ("x" * 50,), ("",)], "title string")
    seqs = [r.seq for r in N.pad_sequence(df).collect()]
    assert seqs[0] == [97, 98] + [0] * 38
    assert seqs[1] == [120] * 40
    assert seqs[2] == [0] * 40


def test_anchor_similarity_edges(spark):
    vecs = spark.createDataFrame([("钢铁", [1.0, 0.0]), ("煤炭", [1.0, 1.0]), ("零", [0.0, 0.0]), ("银行", [0.0, 1.0])],
                                 "word string, vec array<float>")
    words = spark.createDataFrame([(1, "煤炭"), (1, "银行"), (2, "煤炭"), (2, "未知"), (3, "零")],
                                  "post_id int, word string")
    rows = N.anchor_similarity(words, vecs, "钢铁").collect()
    # post 2 has an unknown word -> dropped; post 3 is a zero vector -> NaN -> dropped
    assert [(r.post_id, r.similarity) for r in rows] == [(1, round((0.7071067811865475 + 0.0) / 2, 3))]


def test_sector_keywords(spark):
    sectors = spark.createDataFrame([(1, "coal mining and processing"), (2, "banks")], "bk_code int, bk_name string")
    pos = spark.createDataFrame([("coal", "n"), ("processing", "v"), ("and", "c")], "word string, tag string")
    got = {r.bk_code: r.keywords for r in N.sector_keywords(sectors, pos).collect()}
    assert got == {1: ["coal", "processing"], 2: []}


def test_remove_stopwords_join_equals_array_form(spark):
    df = spark.createDataFrame([(1, ["a", "the", "b", "a"]), (2, ["the"]), (3, [])], "k int, tokens array<string>")
    sw = spark.createDataFrame([("the",), ("x",)], "term string")
    got = {r.k: r.tokens for r in N.remove_stopwords_join(df, sw, "k").collect()}
    want = {r.k: r.tokens for r in N.remove_stopwords(df, ["the", "x"]).collect()}
    assert got == want == {1: ["a", "b", "a"], 2: [], 3: []}


def test_pooled_regression(spark):
    from saiflow.operators.index import pooled_regression
    rows = [(float(i), float(i % 3), 2.0 * i - 1.0 * (i % 3) + 0.5 + (0.01 if i % 2 else -0.01)) for i in range(30)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    got = {r.term: r for r in pooled_regression(df, "y", ["x1", "x2"]).collect()}
    assert abs(got["x1"].coef - 2.0) < 1e-2 and abs(got["x2"].coef + 1.0) < 1e-2
    assert abs(got["intercept"].coef - 0.5) < 5e-2 and got["x1"].std_err > 0


def test_duplicate_vectors_and_title_similarity(spark):
    vecs = spark.createDataFrame([("钢铁", [1.0, 0.0]), ("钢铁", [1.0, 0.0]), ("煤炭", [1.0, 1.0]), ("煤炭", [9.0, 1.0])], "word string, vec array<float>")
    words = spark.createDataFrame([(1, "煤炭")], "post_id int, word string")
    assert [r.similarity for r in N.anchor_similarity(words, vecs, "钢铁").collect()] == [0.707]
    posts = spark.createDataFrame([(1, "煤炭大涨钢铁"), (2, "大涨")], "post_id int, title string")
    pos = spark.createDataFrame([("煤炭", "n"), ("钢铁", "n"), ("大涨", "v")], "word string, tag string")
    got = N.title_similarity(posts, ["煤炭", "大涨", "钢铁"], pos, vecs, "钢铁").collect()
    assert [(r.post_id, r.similarity) for r in got] == [(1, round((0.7071067811865475 + 1) / 2, 3))]


def test_small_slopes_are_kept(spark):
    from saiflow.operators.index import attention_regression
    days = [__import__("datetime").date(2024, 1, d) for d in range(1, 29)]
    n = [1_000_000 + 37 * k * k for k in range(28)]
    sai = spark.createDataFrame([("s", d, x) for d, x in zip(days, n)], "bk_code string, period date, n_posts long")
    ret = spark.createDataFrame([("s", d, 1e-9 * n[k - 1] if k else None, 1.0) for k, d in enumerate(days)],
                                "bk_code string, period date, ret double, log_amount double")
    r = attention_regression(sai, ret).first()
    assert abs(r.slope - 1e-9) < 1e-15 and r.n_obs == 27
