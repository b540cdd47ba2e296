"""Lexicon tables, best-path segmentation, tagging."""
import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saiflow.operators import lexicon as X
from saiflow.operators import segment as S
from saiflow.operators import tagging as T
from saiflow.operators import text as N


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab. ", max_size=14)), max_size=8),
       st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="ab. ", max_size=5)), st.sampled_from(["put", "call"])), max_size=10))
def test_lexicon_join_equals_contains(spark_session_holder, titles, terms):
    spark = spark_session_holder
    posts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], "ord long, title string, label2 string")
    lexicon = spark.createDataFrame(terms, "term string, side string")
    real = {(t, s) for t, s in terms if t and t.strip(" ")}
    hits = {(i, s, t) for i, title in enumerate(titles) for t, s in real if title is not None and t in title}
    assert {tuple(r) for r in X.lexicon_matches(posts, lexicon, ["ord"]).collect()} == hits
    label = {r.ord: r.label for r in X.lexicon_label_join(posts, lexicon, ["ord"]).collect()}
    sides = {i: {s for j, s, _ in hits if j == i} for i in range(len(titles))}
    assert label == {i: "put" if s == {"put"} else "call" if s == {"call"} else "unknown" for i, s in sides.items()}
    counts = {(r.side, r.term): r.n_titles for r in X.lexicon_count_join(posts, lexicon, ["ord"]).collect()}
    assert counts == {(s, t): sum(h[1:] == (s, t) for h in hits) for t, s in real}


def test_lexicon_is_not_in_the_plan(spark):
    posts = spark.createDataFrame([(1, "some words")], "ord long, title string")
    lexicon = spark.createDataFrame([(f"term{k}", "put") for k in range(3000)], "term string, side string")
    out = X.lexicon_label_join(posts, lexicon, ["ord"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "term17" not in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_titles_meet_a_held_lexicon_where_they_lie(spark):
    """No join by title, none by gram: candidates are searched in the task that cut them."""
    posts = spark.createDataFrame([(k, f"title {k} of words and more words") for k in range(50)] + [(None, "words"), (60, None)], "ord long, title string")
    lexicon = spark.createDataFrame([("word", "put"), ("of words and", "call"), ("w", "put"), ("absent words", "call"), (" ", "put"), (None, "call")], "term string, side string")
    found = X.lexicon_matches(posts, lexicon, ["ord"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord" not in plan and "hashpartitioning(gram" not in plan and "SortMergeJoin" not in plan
    want = sorted((k, *x) for k in range(50) for x in [("put", "word"), ("call", "of words and"), ("put", "w")])
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sorted(tuple(r) for r in X.lexicon_matches(posts, lexicon, ["ord"], held_bytes=0).collect()) == want
    # rows of one key, as by exchanged grams
    more = posts.unionByName(posts.where("ord < 3 or ord is null"))
    both = [sorted(tuple(r) for r in X.lexicon_matches(more, lexicon, ["ord"], held_bytes=n).collect()) for n in (0, 1 << 20)]
    assert both[0] == both[1] == sorted(want + 3 * [w for w in want if w[0] < 3])


@given(st.text(alphabet="ab é", max_size=12), st.sets(st.integers(1, 6)))
def test_substrings(text, lengths):
    found = X.substrings(text, sorted(lengths))
    assert sorted(found) == sorted({text[i:i + n] for n in lengths for i in range(len(text) - n + 1)})


def all_cuts(run, known):
    """(sum, words) of every way to cut a run."""
    if not run:
        return [(0, [])]
    out = []
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in known:
            w = known.get(run[:k], known[""])
            out += [(w + s, [run[:k], *rest]) for s, rest in all_cuts(run[k:], known)]
    return out


def test_best_path_equals_all_cuts():
    rng = random.Random(6)
    for _ in range(60):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 30) for _ in range(8)}
        total = sum(words.values())
        known = {w: math.floor(math.log(n / total) * 1e6 + 0.5) for w, n in words.items()} | {"": math.floor(math.log(1 / total) * 1e6 + 0.5)}
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        cuts = all_cuts(run, known)
        top = max(s for s, _ in cuts)
        want = max((w for s, w in cuts if s == top), key=lambda w: [len(x) for x in w])
        assert S.Trie(known).cut(run) == want


def test_best_path_where_the_longest_word_is_wrong(spark):
    # 研究生命起源: the longest first word takes 研究生 and leaves 命
    dictionary = spark.createDataFrame([("研究", 50), ("研究生", 5), ("生命", 40), ("起源", 20), ("命", 2), ("研究", 10), ("", 9), (None, 1)], "word string, freq long")
    posts = spark.createDataFrame([(1, "研究生命起源 ABC 研究生"), (2, None), (3, "")], "ord long, title string")
    got = {r.ord: r.tokens for r in S.segment_best_path(posts, dictionary).collect()}
    assert got == {1: ["研究", "生命", "起源", "ABC", "研究生"], 2: None, 3: []}
    greedy = {r.ord: r.tokens for r in N.tokenize_posts(posts, "title", ["研究", "研究生", "生命", "起源"]).collect()}
    assert greedy[1][:3] == ["研究生", "命", "起源"]


def test_dictionary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_DICTIONARY", 3)
    posts = spark.createDataFrame([("甲",)], "title string")
    with pytest.raises(ValueError, match="may hold 3"):
        S.segment_best_path(posts, spark.createDataFrame([(c, 1) for c in "甲乙丙丁"], "word string, freq long"))


TRAINING = [["the/d", "old/a", "man/n", "walks/v"], ["the/d", "old/n", "man/v", "the/d", "boat/n"], ["a/d", "boat/n", "walks/v"],
            ["the/d", "man/n", "sees/v", "a/d", "old/a", "boat/n"], ["they/n", "man/v", "a/d", "boat/n"]]


def brute_tags(sentence, start, follow, emits, tags):
    best = None
    for path in itertools.product(range(len(tags)), repeat=len(sentence)):
        score = start[path[0]] + sum(follow[a][b] for a, b in zip(path, path[1:])) + sum(e[t] for e, t in zip(emits, path))
        key = (score, [-t for t in reversed(path)])
        best = max(best, (key, path)) if best else (key, path)
    return [tags[t] for t in best[1]]


def test_tags_follow_context_and_equal_brute_force(spark):
    rows = [(k, i, *w.split("/")) for k, s in enumerate(TRAINING) for i, w in enumerate(s)] + [(9, 0, None, "n"), (9, 1, "x", None)]
    tagger = T.fit_tagger(spark.createDataFrame(rows, "sentence long, i long, word string, tag string"))
    assert tagger.tags == ["a", "d", "n", "v"]
    tagged = [(s, "d", "n") for s in range(5)]
    n = lambda c, t, k: math.floor(math.log((c + 1) / (t + k)) * 1e6 + 0.5)
    assert tagger.start == [n(0, 5, 4), n(4, 5, 4), n(1, 5, 4), n(0, 5, 4)] and len(tagged) == 5
    assert tagger.follow[1] == [n(2, 7, 4), n(0, 7, 4), n(5, 7, 4), n(0, 7, 4)]
    asked = ["the old man walks", "they man the boat", "the old man the boat", "a strange man walks", "boat", "walks walks"]
    words = {r.word: list(r.emit) for r in tagger.words.collect()}
    sentences = spark.createDataFrame([(k, i, w) for k, s in enumerate(asked) for i, w in enumerate(s.split())] + [(99, 0, None)], "sentence long, i long, word string")
    got = {r.sentence: (r.words, r.tags) for r in T.tag_words(tagger, sentences).collect()}
    assert got == {k: (s.split(), brute_tags(s.split(), tagger.start, tagger.follow, [words.get(w, tagger.unknown) for w in s.split()], tagger.tags))
                   for k, s in enumerate(asked)}
    assert got[0][1][2] == "n" and got[1][1][1] == "v"  # one word, two tags
    kept = {r.sentence: r.keywords for r in T.tagged_keywords(tagger, sentences).collect()}
    assert kept[1] == ["they", "man", "boat"]


def test_tagging_without_rows(spark):
    with pytest.raises(ValueError, match="no tagged words"):
        T.fit_tagger(spark.createDataFrame([(1, 0, None, "n")], "sentence long, i long, word string, tag string"))


def test_equal_sequences_take_the_lesser_tag(spark):
    rows = [(k, 0, "w", t) for k, t in enumerate("xy")] + [(k + 5, i, "w", t) for k, p in enumerate(itertools.product("xy", repeat=2)) for i, t in enumerate(p)]
    tagger = T.fit_tagger(spark.createDataFrame(rows, "sentence long, i long, word string, tag string"))
    got = T.tag_words(tagger, spark.createDataFrame([(1, i, "w") for i in range(5)], "sentence long, i long, word string")).select(F.array_join("tags", "")).first()[0]
    assert got == "xxxxx"
