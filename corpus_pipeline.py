"""A training corpus from ``documents``: toxic texts go, near copies and repeated passages go,
benchmark passages go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, and any others the table has; n_chars follows the text.

Defined results: null and empty texts, and rows without id, pass every filter
(an empty text is toxic, near or contaminated by nothing) and are packed as rows of their own;
of rows repeated as a whole one stays; rows that share an id are judged each by
its text; long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saiflow.llm import decontaminate, minhash, packing, suffix_dedup, toxicity
from saiflow.llm.catalog import tokenizer_file
from saiflow.llm.common import stage, table

#: Packing depends on a tokenizer and near copies on signatures, which SQL cannot express.
ORACLE_SQL = None


def carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all of ``docs`` in one, so that no column of theirs meets one of the same name."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by the positive-unlabelled classifier."""
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"), may_learn=toxicity.fold() != 1)
    scored = toxicity.score(spark, carried(docs), classifier, threshold=0.7)
    return scored.filter("predicted = 0").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by Jaccard similarity of at least 0.8 on five-word shingles."""
    return minhash.keep_one(spark, docs, shingle_words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes or more that occur elsewhere too; whole characters only. A null text stays null."""
    cut = suffix_dedup.remove_repeats(spark, carried(docs), length=200, whole_chars=True)
    text = F.when(F.col("_doc.text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*(changed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(carried(docs), table(spark, sf_dir, "benchmark"), similarity=0.8).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of at most 4096 tokens."""
    return packing.pack(spark, docs, tokenizer_file("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
