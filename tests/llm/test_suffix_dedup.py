import random
from collections import Counter

from saiflow.llm.suffix_array import suffix_array
from saiflow.llm.suffix_dedup import cut_text, remove_repeats


def brute(texts, length):
    """{position in texts: (kept, spans)} by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans, at = [], 0
        while at < len(r):
            end = at
            while end < len(r) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((bytes(c for c, g in zip(r, gone) if not g), spans))
    return out


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in df.collect())


def expected(rows, length):
    return sorted((r[0] is not None, r[0] or 0, kept, spans) for r, (kept, spans) in zip(rows, brute([r[1] for r in rows], length)))


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(40))]
        if rng.random() < 0.3:
            text = text[:5] * 8
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_edge_rows_match_brute_force(spark, edge_docs, edge_rows):
    got = remove_repeats(spark, edge_docs, length=200, gram=64)
    assert {"key", "node", "lang", "n_bytes"} <= set(got.columns)
    assert rows_of(got) == expected(edge_rows, 200)


def test_many_variants_of_one_passage(spark):
    """Many different neighbours of one passage, also through the path for large groups."""
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(90)).decode()
    texts = ["".join(rng.choice("xyzuv ") for _ in range(rng.randrange(0, 60))) + passage[rng.randrange(0, 40):] +
             "".join(rng.choice("xyzuv ") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1000, 3):
        assert rows_of(remove_repeats(spark, docs, length=50, gram=16, group_limit=limit)) == expected(rows, 50)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x" * 300, 7, "m", None, "k"), (2, "y", 8, "n", "d", "k")],
                                 "doc_id long, text string, a int, marks string, digest string, kept string")
    got = {r.doc_id: r for r in remove_repeats(spark, docs).collect()}
    assert (got[1].a, got[1].marks, got[2].digest) == (7, "m", "d")
    assert bytes(got[1].kept) == b"" and got[1].n_bytes == 300 and bytes(got[2].kept) == b"y"


def test_empty_table(spark, no_docs):
    assert remove_repeats(spark, no_docs).count() == 0


def test_whole_characters_stay():
    raw = "aé日b".encode()
    kept, spans = cut_text(raw, [{"lo": 2, "marks": [{"from": 0, "to": 0}]}], 3, whole_chars=True)
    assert kept.decode() == "aé日b"[:2] + "日b" and spans == []
    assert cut_text(raw, [{"lo": 0, "marks": [{"from": 1, "to": 1}]}], 5)[0] == b"ab"
