from hypothesis import given, settings
from hypothesis import strategies as st

from frames import posts_df
from saiflow import constants as K
from saiflow.operators import labels as L

GOLDEN = "牛市来了，他来了！证券为先，南京证券绝对龙头！每次证券启动，不到三五倍不算完。"


def test_reference_lexicon(spark):
    assert len(K.BEARISH_TERMS) == 74 and len(K.BULLISH_TERMS) == 22
    df = posts_df(spark, [("600999", "2024-01-02 10:00:00", GOLDEN, "a"),
                          ("600999", "2024-01-02 10:01:00", "跳水了快跑", "b"),
                          ("600999", "2024-01-02 10:02:00", "下跌后拉升", "c"),
                          ("600999", "2024-01-02 10:03:00", None, "d"),
                          ("600999", "2024-01-02 10:04:00", "平淡", "e")])
    got = {r.author: r.label for r in L.lexicon_label(df).collect()}
    assert got == {"a": "call", "b": "put", "c": "unknown", "d": "unknown", "e": "unknown"}


def test_regex_chars_in_terms(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "axb"), (3, "(x)")], "ord long, title string")
    got = {r.ord: r.label for r in L.lexicon_label(df, ["a.b"], ["(x"]).collect()}
    assert got == {1: "put", 2: "unknown", 3: "call"}


def sticky_loop(titles, put_words, call_words):
    put = call = False
    out = []
    for t in titles:
        put = put or any(w in t for w in put_words)
        call = call or any(w in t for w in call_words)
        out.append("put" if put and not call else "call" if call and not put else "unknown")
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="xyab", max_size=6), min_size=1, max_size=12))
def test_cumulative_equals_loop(spark_session_holder, titles):
    spark = spark_session_holder
    df = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    got = [r.label for r in L.lexicon_label_cumulative(df, "ord", ["ab"], ["y"]).orderBy("ord").collect()]
    assert got == sticky_loop(titles, ["ab"], ["y"])


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "跳水跳水"), (2, "跳水 涨停"), (3, None)], "ord long, title string")
    got = {(r.side, r.term): r.n_titles for r in L.lexicon_term_counts(df, ["跳水"], ["涨停"]).collect()}
    assert got == {("put", "跳水"): 2, ("call", "涨停"): 1}


def test_token_bayes_small(spark):
    train = spark.createDataFrame([("up up good", 1), ("good gain", 1), ("down bad", 0), ("bad loss down", 0), (None, 1), ("x", None)],
                                  "text string, label int")
    prior, words = L.fit_token_bayes(train)
    # V = 6 words; class 1 has 5 tokens: P(up|1) = (2+1)/(5+6)
    import math
    got = {r.w: r.d for r in words.collect()}
    assert len(got) == 6 and abs(got["up"] - (math.log(1 / 11) - math.log(3 / 11))) < 1e-12
    posts = spark.createDataFrame([(1, "good up"), (2, "bad"), (3, "unseen"), (4, None)], "k int, text string")
    out = L.score_token_bayes(prior, words, posts, "k")
    assert out.columns == ["sentiment_label", "sentiment_key", "positive_probs", "negative_probs", "text"]
    rows = {r.text: r for r in out.collect()}
    assert set(rows) == {"good up", "bad", "unseen"}
    assert rows["good up"].sentiment_key == "positive" and rows["bad"].sentiment_key == "negative"
    assert rows["unseen"].positive_probs == 0.5 and rows["unseen"].sentiment_label == 0
