import public_tokenizers
from saiflow.llm import token_rollup as tr
from tokenizers import Tokenizer


def test_batches_take_effect_once(spark, tmp_path):
    store = tr.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", 5, 7), ("a", None, 2, 3), (None, "en", None, 1), ("b", "en", 4, 4), ("b", "en", 4, 4)],
                                 "source string, lang string, tokens long, other long")
    assert store.commit(1, tr.signed(rows, 1, "v1"))
    assert not store.commit(1, tr.signed(rows, 1, "v1"))
    assert store.commit(2, tr.signed(rows.filter("source = 'b'"), -1, "v1"))
    assert store.commit(3, tr.revised(rows.filter("source = 'a'"), "v1", "tokens", "v2", "other"))
    assert not store.commit(3, tr.signed(rows, 1, "v9"))
    assert store.commit(4, tr.signed(rows.limit(0), 1, "v1"))
    got = {tuple(r) for r in tr.Rollup(spark, str(tmp_path / "r")).totals().collect()}
    assert got == {("a", "en", "v2", 1, 7), ("a", None, "v2", 1, 3), (None, "en", "v1", 1, 0)}


def test_unfinished_batch_is_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, tokens long")
    store = tr.Rollup(spark, str(tmp_path))
    tr._sums(tr.signed(rows, 1, "v")).write.parquet(str(tmp_path / "batch=1"))
    (tmp_path / "batch=1" / "_SUCCESS").unlink()
    assert store.totals().count() == 0
    assert store.commit(1, tr.signed(rows, 1, "v"))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 1, 5)]


def test_counts_match_the_library(spark, edge_docs, edge_rows):
    for name, make in (("word_bpe_49k", tr.word_counter), ("byte_bpe_50k", tr.library_counter)):
        file = public_tokenizers.path(f"{name}.json")
        tok = Tokenizer.from_file(file)
        tok.encode_special_tokens = name.startswith("byte")
        want = sorted(len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows)
        assert sorted(r.tokens for r in tr.with_tokens(edge_docs, make(file), ["doc_id", "key"]).collect()) == want


def test_query_matches_brute_force(spark):
    from saiflow.llm.catalog import op3_token_rollup, table

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "", r.source, r.lang) for r in table(spark, sf, "documents").collect()]
    low = {r.doc_id for r in table(spark, sf, "labels").filter("quality = 0").collect()}
    tok = {n: Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k")}
    least: dict = {}
    for d, t, _, _ in docs:
        least[t] = min(least.get(t, d), d)
    want: dict = {}
    for d, t, s, lang in docs:
        if least[t] == d:
            name = "byte_bpe_50k" if d in low else "word_bpe_49k"
            n, k = want.get((s, lang, name), (0, 0))
            want[s, lang, name] = n + 1, k + len(tok[name].encode(t, add_special_tokens=False).ids)
    assert {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in op3_token_rollup(spark, sf).collect()} == want


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9), (2, None, "y", 9)], "doc_id long, text string, _text string, tokens int")
    file = public_tokenizers.path("word_bpe_49k.json")
    got = tr.with_tokens(docs, tr.word_counter(file), ["doc_id", "_text", "text", "tokens"])
    assert got.columns == ["doc_id", "_text", "text", "tokens"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", "a b", 2), (2, "y", None, 0)]
