import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import posts_df
from saiflow.functions.exprs import py_slice
from saiflow.operators import clean as C


def lcs_len(a: str, b: str) -> int:
    best = 0
    prev = [0] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        cur = [0] * (len(b) + 1)
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                cur[j] = prev[j - 1] + 1
                best = max(best, cur[j])
        prev = cur
    return best


def lcs_first(a: str, b: str):
    """Longest common substring, first longest in ``a``; ('', 0) if none."""
    best, end = 0, 0
    for i in range(len(a)):
        for j in range(i + 1, len(a) + 1):
            if j - i > best and a[i:j] in b:
                best, end = j - i, j
    return a[end - best:end], best


ROWS = [
    ("000001", "2024-01-02 09:00:00", "正常的标题", "张三"),
    ("000001", "2024-01-02 09:01:00", "【公告】标题", "李四"),
    ("000001", "2024-01-02 16:59:00", "价格$100", "王五"),
    ("000001", "2024-01-02 17:00:00", "收盘", "股吧"),
    ("000001", "2024-01-03 10:00:00", "早盘", "东方资讯"),
    ("000001", "2024-01-03 10:30:00", None, "赵六"),
    ("600999", "2024-02-29 11:00:00", "闰日", "钱七"),
]


def test_special_chars_authors_nulls(spark):
    df = posts_df(spark, ROWS)
    kept = C.clean_posts(df).select("title").collect()
    assert sorted(r.title for r in kept) == sorted(["正常的标题", "闰日"])
    assert C.filter_code(df, "000001").count() == 6   # leading zeros kept


def test_session_hours_open_bounds(spark):
    df = posts_df(spark, ROWS)
    got = sorted(r.dtime.strftime("%H:%M") for r in C.filter_session_hours(df).collect())
    assert got == ["09:01", "10:00", "10:30", "11:00", "16:59"]
    edge = posts_df(spark, [("x", "2024-01-02 09:00:00.000001", "t", "a"), ("x", "2024-01-02 16:59:59.999999", "t", "a")])
    assert C.filter_session_hours(edge).count() == 2


def test_drop_incomplete_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k int, v double")
    assert [r.k for r in C.drop_incomplete(df).collect()] == [1]


def test_name_overlap_empty_string_keeps_all(spark):
    df = posts_df(spark, ROWS)
    names = spark.createDataFrame([], "ord long, name string")
    assert C.filter_name_overlap(df, C.name_grams(names)).count() == len(ROWS)


def test_name_overlap_cross_boundary(spark):
    names = spark.createDataFrame([(1, "奥福环保"), (2, "天奈科技"), (3, "合康新能")], "ord long, name string")
    df = posts_df(spark, [("x", "2024-01-02 10:00:00", "看好环保天奈", "a"),      # crosses a name boundary
                          ("x", "2024-01-02 10:00:00", "天奈科技大涨", "b"),
                          ("x", "2024-01-02 10:00:00", "科技股回调", "c")])
    kept = C.filter_name_overlap(df, C.name_grams(names)).select("author").collect()
    assert [r.author for r in kept] == ["c"]
    per_name = C.filter_name_overlap(df, C.name_grams(names, per_name=True)).select("author").collect()
    assert sorted(r.author for r in per_name) == ["a", "c"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abcde", min_size=0, max_size=12), min_size=1, max_size=6),
       st.text(alphabet="abcdef", min_size=0, max_size=30))
def test_four_gram_filter_equals_lcs(spark_session_holder, titles, names):
    spark = spark_session_holder
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "ord long, title string")
    nm = spark.createDataFrame([(0, names)], "ord long, name string")
    kept = {r.ord for r in C.filter_name_overlap(df, C.name_grams(nm)).collect()}
    want = {i for i, t in enumerate(titles) if lcs_len(t, names) < 4}
    assert kept == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=0, max_size=24), min_size=1, max_size=5),
       st.text(alphabet="abc", min_size=1, max_size=40))
def test_longest_match_equals_dp(spark_session_holder, titles, names):
    spark = spark_session_holder
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "ord long, title string")
    nm = spark.createDataFrame([(0, names)], "ord long, name string")
    got = {r.ord: (r.max_sub, r.max_len) for r in
           C.longest_name_match(df, nm, ["ord"], start_cap=2).collect()}
    assert got == {i: lcs_first(t, names) for i, t in enumerate(titles)}


def test_longest_match_of_every_length(spark):
    """Matches that end below, at and above the top of each search, and the first of equal ones."""
    import random
    rng = random.Random(4)
    letters = "abcdefghij"
    names = ["".join(rng.choice(letters) for _ in range(n)) for n in (50, 3, 1, 40, 7)]
    whole = "".join(names)
    titles = [f"X{whole[at:at + n]}Y" for n in range(42) for at in (0, 30, 55)] + [whole, whole[5:12] + "-" + whole[20:27], None, ""]
    df = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    nm = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    got = {r.ord: (r.max_sub, r.max_len) for r in C.longest_name_match(df, nm, ["ord"], start_cap=3).collect()}
    assert got == {i: lcs_first(t or "", whole) for i, t in enumerate(titles)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.integers(-15, 15), st.integers(-15, 15)), min_size=1, max_size=40))
def test_py_slice(spark_session_holder, cases):
    spark = spark_session_holder
    df = spark.createDataFrame(cases, "s string, a int, b int")
    got = df.select(*[py_slice(F.lit(s), a, b).alias(f"r{i}") for i, (s, a, b) in enumerate(cases)]).first()
    assert [got[f"r{i}"] for i in range(len(cases))] == [s[a:b] for s, a, b in cases]


def test_pages_until_cutoff(spark):
    rows = []
    for page, day in [(1, 25), (2, 24), (3, 22), (4, 20), (5, 24), (6, 19)]:
        rows.append((page, dt.datetime(2024, 1, day, 14, 0)))
    rows.append((4, dt.datetime(2024, 1, 20, 13, 10)))   # page 4 reaches the cut-off exactly
    df = spark.createDataFrame(rows, "page_no int, dtime timestamp_ntz")
    got = sorted({r.page_no for r in C.pages_until_cutoff(df, "2024-01-20", 2).collect()})
    assert got == [2, 3]
    assert sorted({r.page_no for r in C.pages_by_count(df, 2, 3).collect()}) == [2, 3, 4]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz", min_size=0, max_size=4), min_size=0, max_size=30),
       st.integers(1, 5), st.integers(1, 4))
def test_concat_grams_equal_python(spark_session_holder, names, n_max, buckets):
    """Grams of the concatenated string, built range by range, equal the
    grams of the string itself (1-character names and tiny ranges included)."""
    spark = spark_session_holder
    df = spark.createDataFrame([(i * 7, n) for i, n in enumerate(names)] or [(0, None)], "ord long, name string")
    got = {r.gram for r in C.concat_grams(df, 1, n_max, buckets=buckets).collect()}
    s = "".join(names)
    want = {s[i:i + k] for i in range(len(s)) for k in range(1, n_max + 1) if i + k <= len(s)}
    assert got == want
