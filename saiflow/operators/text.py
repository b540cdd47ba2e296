"""Text operators: tokenising, stop words, sequence padding, word-vector
similarity and sector keywords (N1, N2, N5, N6, C8, C9, C12, F14)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.exprs import cosine_similarity, pad_codes

WORD_RE = r"[\p{L}\p{N}]+"
# words of a segmentation dictionary: what each Python worker may hold (about 100 MB)
MAX_DICTIONARY = 1_000_000



def tokens(text: Column | str) -> Column:
    """N1 for spaced scripts: the runs of letters/digits of a text, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(WORD_RE), 0)


def make_segmenter(dictionary: Sequence[str], max_word: int | None = None):
    """N1 for Chinese: a vectorised (Arrow) UDF that splits each run of Han
    characters by forward longest match against ``dictionary``; other tokens
    pass through. The dictionary travels with the function to every executor
    once, so its size is bounded; each batch is processed as a pandas Series."""
    words = frozenset(w for w in dictionary if w)
    if len(words) > MAX_DICTIONARY:
        raise ValueError(f"{len(words)} words: a segmentation dictionary may hold {MAX_DICTIONARY}")
    longest = max_word or max((len(w) for w in words), default=1)

    def cut(run: str) -> list[str]:
        out, i, n = [], 0, len(run)
        while i < n:
            for L in range(min(longest, n - i), 0, -1):
                if L == 1 or run[i:i + L] in words:
                    out.append(run[i:i + L])
                    i += L
                    break
        return out

    import re
    han = re.compile(r"^[㐀-䶿一-鿿豈-﫿]+$")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(tok_lists: pd.Series) -> pd.Series:
        def one(toks):
            if toks is None:
                return None
            res = []
            for tk in toks:
                res.extend(cut(tk) if han.match(tk) else [tk])
            return res
        return tok_lists.map(one)

    return segment


def tokenize_posts(posts: DataFrame, title_col: str = "title", dictionary: Sequence[str] | None = None,
                   out_col: str = "tokens") -> DataFrame:
    """``tokens`` array column; Chinese runs are segmented when a dictionary is given."""
    col = tokens(title_col)
    if dictionary:
        col = make_segmenter(dictionary)(col)
    return posts.withColumn(out_col, col)


def remove_stopwords(df: DataFrame, stopwords: Sequence[str], tokens_col: str = "tokens",
                     first_char: bool = False) -> DataFrame:
    """N2. Intended form: drop tokens that are stop words (repeats kept, order kept).

    ``first_char=True`` is the literal rule of the original: a token is dropped
    when its FIRST CHARACTER is in the list (so multi-character stop words and
    the placeholders appended to the list never match).
    """
    sw = list(dict.fromkeys([w for w in stopwords if w] + K.STOPWORD_PLACEHOLDERS))
    # a literal list of more than ten is looked up in a hash set
    if first_char:
        keep = lambda t: ~F.substring(t, 1, 1).isin(sw)
    else:
        keep = lambda t: ~t.isin(sw)
    return df.withColumn(tokens_col, F.filter(F.col(tokens_col), keep))


def remove_stopwords_join(df: DataFrame, stopwords: DataFrame, key_col: str, tokens_col: str = "tokens") -> DataFrame:
    """N2 for large stop-word tables: tokens are exploded with their position,
    anti-joined with the ``stopwords(term)`` table (broadcast by AQE when it is
    small, shuffled otherwise) and gathered back per post in order (one
    post's tokens per group). Posts left without tokens get an empty list."""
    toks = df.select(key_col, F.posexplode(tokens_col).alias("_i", "_w"))
    kept = toks.join(stopwords.select(F.col("term").alias("_w")).distinct(), "_w", "left_anti")
    back = kept.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_k"))
    return (df.drop(tokens_col).join(back, key_col, "left")
              .withColumn(tokens_col, F.coalesce(F.transform("_k", lambda x: x["_w"]), F.array().cast("array<string>")))
              .drop("_k"))


def pad_sequence(df: DataFrame, text_col: str = "title", length: int = K.SEQUENCE_LENGTH,
                 out_col: str = "seq") -> DataFrame:
    """Fixed-length character-code sequence (cut, or zeros at the end)."""
    return df.withColumn(out_col, pad_codes(text_col, length))


def anchor_similarity(post_words: DataFrame, vectors: DataFrame, anchor: str, post_col: str = "post_id",
                      word_col: str = "word", digits: int = 3) -> DataFrame:
    """Mean cosine similarity of each post's words to an
    anchor word, rounded half-even, highest first.

    The similarity is computed once for each word of the vector table, and only
    (word, similarity) meets the posts' words. Of vectors that one word has
    several of, the least stands for it. A post with any word missing from the
    table is dropped, as is a post without words or with an undefined mean (zero vector).
    """
    known = vectors.groupBy("word").agg(F.min("vec").alias("vec"))
    av = vectors.where(F.col("word") == F.lit(anchor)).agg(F.min("vec")).scalar()
    sims = known.withColumn("_av", av).select("word", cosine_similarity("vec", "_av").alias("_s"), F.lit(True).alias("_in"))
    joined = post_words.select(post_col, F.col(word_col).alias("word")).join(sims, "word", "left")
    per_post = joined.groupBy(post_col).agg(F.bool_and(F.col("_in").isNotNull()).alias("_known"), F.avg("_s").alias("_m"))
    out = per_post.where(F.col("_known") & F.col("_m").isNotNull() & ~F.isnan("_m")) \
                  .select(post_col, F.bround("_m", digits).alias("similarity"))
    return out.orderBy(F.desc("similarity"), post_col)


def title_similarity(posts: DataFrame, dictionary: Sequence[str], pos: DataFrame, vectors: DataFrame, anchor: str,
                     tags: Sequence[str] = ("n",), post_col: str = "post_id", title_col: str = "title", digits: int = 3) -> DataFrame:
    """N1 -> N5: titles are segmented, words whose part of speech is in ``tags``
    are kept, and their mean similarity to the anchor is the post's."""
    words = pos.where(F.col("tag").isin(list(tags))).select("word").distinct()
    toks = tokenize_posts(posts, title_col, dictionary).select(post_col, F.explode("tokens").alias("word"))
    return anchor_similarity(toks.join(words, "word", "left_semi"), vectors, anchor, post_col, "word", digits)


def sector_keywords(sectors: DataFrame, pos: DataFrame, tags: Sequence[str] = ("n", "v"),
                    key_col: str = "bk_code", name_col: str = "bk_name", dictionary: Sequence[str] | None = None) -> DataFrame:
    """Content words (POS in ``tags``) of each sector name, in order;
    names without spaces are segmented by ``dictionary``.

    Tokens are exploded with their position, semi-joined with the POS table,
    and gathered back per sector (bounded by the length of one name).
    """
    words = pos.where(F.col("tag").isin(list(tags))).select("word").distinct()
    toks = tokenize_posts(sectors, name_col, dictionary).select(key_col, F.posexplode("tokens").alias("i", "word"))
    kept = toks.join(words, "word", "left_semi")
    agg = kept.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("_w"))
    out = sectors.select(key_col).join(agg, key_col, "left")
    return out.select(key_col, F.coalesce(F.transform("_w", lambda x: x["word"]),
                                          F.array().cast("array<string>")).alias("keywords"))
