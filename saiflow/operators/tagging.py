"""Part-of-speech tags by a hidden Markov model.

The model is counts of tagged text: how often a tag begins a sentence, follows
another, and is a word's. Counting and tagging are DataFrame jobs; a sentence's
best sequence of tags (Viterbi) is one fold over its words in built-in
functions. Weights are logarithms in millionths, whole numbers, so results do
not depend on the order of sums; equal sequences are settled by the lesser tag, at the last word first.

Counts are smoothed by adding ``smoothing`` to each; a word that was never
seen is as likely under every tag as its smoothing says, so its neighbours decide.
The number of tags is bounded (``MAX_TAGS``) and checked; words and sentences are not.
A sentence is one group, meant to be a title or a phrase: its fold takes time with the square of its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TAGS = 200
SCALE = 1_000_000


def _weight(count: Column, total: Column | float, smoothing: float, kinds: Column | int) -> Column:
    return F.floor(F.log((count + smoothing) / (total + smoothing * kinds)) * SCALE + 0.5).cast("long")


@dataclass
class Tagger:
    """``tags`` in order, ``start`` and ``follow`` weights (K and K x K, by the tag before), ``words``:
    word, emit (a weight for each tag), ``unknown``: such weights of a word that is not among them."""

    tags: list[str]
    start: list[int]
    follow: list[list[int]]
    words: DataFrame
    unknown: list[int]


def fit_tagger(tagged: DataFrame, smoothing: float = 1.0) -> Tagger:
    """A tagger from ``tagged(sentence, i, word, tag)``; rows with a null word or tag are left out. Words are
    counted in Spark and stay there; the driver gets the counts of tags and of pairs of tags, at most MAX_TAGS^2 rows."""
    rows = tagged.where(F.col("word").isNotNull() & F.col("tag").isNotNull()).select("sentence", "i", "word", "tag")
    tags = sorted(r[0] for r in rows.select("tag").distinct().limit(MAX_TAGS + 1).collect())
    if not tags:
        raise ValueError("no tagged words to learn from")
    if len(tags) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    before = F.lag("tag").over(Window.partitionBy("sentence").orderBy("i"))
    pairs = rows.select(before.alias("a"), F.col("tag").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("a")
    pairs = pairs.withColumn("_t", F.sum("n").over(total))
    seen = {(r.a, r.b): r.w for r in pairs.select("a", "b", _weight(F.col("n"), F.col("_t"), smoothing, len(tags)).alias("w")).collect()}
    none = {r.a: r.w for r in pairs.select("a", _weight(F.lit(0), F.col("_t"), smoothing, len(tags)).alias("w")).distinct().collect()}
    start = [seen.get((None, t), none.get(None, 0)) for t in tags]
    follow = [[seen.get((a, b), none.get(a, 0)) for b in tags] for a in tags]

    counts = rows.groupBy("word").agg(*(F.count_if(F.col("tag") == t).alias(f"_{k}") for k, t in enumerate(tags)))
    vocabulary = counts.count()
    per_tag = counts.agg(*(F.sum(f"_{k}") for k in range(len(tags)))).first()
    # one word more stands for all that were never seen
    emit = F.array(*(_weight(F.col(f"_{k}"), float(per_tag[k] or 0), smoothing, vocabulary + 1) for k in range(len(tags))))
    never = counts.sparkSession.range(1).select(*(F.lit(0).alias(f"_{k}") for k in range(len(tags)))).select(emit.alias("e")).first().e
    return Tagger(tags, start, follow, counts.select("word", emit.alias("emit")), list(never))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def best_tags(emits: Column, tagger: Tagger) -> Column:
    """The numbers of the most probable tags of a sentence, from the ``emit`` arrays of its words in order."""
    k = len(tagger.tags)
    start, follow = _longs(tagger.start), _longs([w for row in tagger.follow for w in row])
    every = F.sequence(F.lit(0), F.lit(k - 1))
    no_tags = F.array().cast("array<int>")

    def first(e: Column) -> Column:
        return F.transform(every, lambda t: F.struct((F.get(start, t) + F.get(e, t)).alias("score"), F.concat(no_tags, F.array(t)).alias("path")))

    def following(ends: Column, e: Column) -> Column:
        def to(t: Column) -> Column:
            by = F.transform(ends, lambda s, a: F.struct((s["score"] + F.get(follow, a * k + t)).alias("score"), (-a).alias("_less"), s["path"].alias("path")))
            return F.get(F.transform(F.array(F.array_max(by)), lambda b: F.struct((b["score"] + F.get(e, t)).alias("score"),
                                                                                F.concat(b["path"], F.array(t)).alias("path"))), F.lit(0))

        return F.transform(every, to)

    ends = F.aggregate(F.slice(emits, F.lit(2), F.greatest(F.size(emits) - 1, F.lit(0))), first(F.get(emits, F.lit(0))), following)
    best = F.array_max(F.transform(ends, lambda s, a: F.struct(s["score"], (-a).alias("_less"), s["path"].alias("path"))))
    return F.when(F.size(emits) > 0, best["path"]).otherwise(no_tags)


def tag_words(tagger: Tagger, sentences: DataFrame) -> DataFrame:
    """sentence, words, tags of ``sentences(sentence, i, word)``: the words in the order of ``i`` and their tags.

    Words meet the table of the model in a join, so a word that most sentences have is split by AQE or the
    table broadcast; a sentence is gathered once.
    """
    rows = sentences.where(F.col("word").isNotNull()).select("sentence", "i", "word").join(tagger.words, "word", "left")
    rows = rows.withColumn("emit", F.coalesce("emit", _longs(tagger.unknown)))
    whole = rows.groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("i", "word", "emit"))).alias("_s"))
    names = F.array(*(F.lit(t) for t in tagger.tags))
    path = best_tags(F.transform("_s", lambda x: x["emit"]), tagger)
    return whole.select("sentence", F.transform("_s", lambda x: x["word"]).alias("words"), F.transform(path, lambda t: F.get(names, t)).alias("tags"))


def tagged_keywords(tagger: Tagger, sentences: DataFrame, keep: tuple[str, ...] = ("n", "v")) -> DataFrame:
    """Sentence, keywords: the words of each sentence whose tag, in that sentence, is one of ``keep``, in order."""
    both = tag_words(tagger, sentences).withColumn("_z", F.arrays_zip("words", "tags"))
    kept = F.filter("_z", lambda z: z["tags"].isin(list(keep)))
    return both.select("sentence", F.transform(kept, lambda z: z["words"]).alias("keywords"))
