"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert (+), a delete (-) or a revised count (- the old, + the
new). A batch of changes is reduced to one signed row for each key (combined
before the shuffle, so a source with a third of all rows is no one task's
work) and committed as a folder of its own, named by its batch id; Spark's
success mark makes it count. A batch id that is committed is skipped, and one
that was left unfinished is written anew, so a batch takes effect once however
often it is sent. Totals are the sums over committed batches.

Defined results: a null source or language is a key of its own; a null text
has no tokens and counts as a document; a long text is counted whole; null counts are 0; repeated rows count each; keys whose documents
and tokens are both 0 are left out; without batches, or of empty ones alone, there are no totals. One writer
commits a batch id at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices
from .packing import word_tokenizer

KEYS = ("source", "lang", "tokenizer_version")
DDL = "source string, lang string, tokenizer_version string, docs long, tokens long"

Counter = Callable[[list[str]], Sequence[int]]


def word_counter(file: str) -> Callable[[], Counter]:
    """Counts of a word-level tokenizer file that ``packing`` can cut at spaces."""
    return lambda: lambda texts: word_tokenizer(file).counts(texts)


def library_counter(file: str) -> Callable[[], Counter]:
    """Counts of any tokenizer file of the library; special tokens' strings are ordinary text."""

    def make() -> Counter:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(file)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]

    return make


def with_tokens(docs: DataFrame, make: Callable[[], Counter], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``tokens``, the number of tokens of the whole text.

    A column ``tokens`` among ``keep`` is replaced; the text goes by a reserved name, so any other may be kept.
    """
    keep = [c for c in keep if c != "tokens"]
    narrow = docs.select(*keep, F.col(text_col).alias("_tr_text"))
    ddl = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1] + [("tokens", "bigint")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            for a, b, _, _ in byte_slices(batch.column(len(keep)), 4 << 20):
                part = batch.slice(a, b - a)
                n = counter([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], [*keep, "tokens"])

    return narrow.mapInArrow(count, ddl)


def signed(counted: DataFrame, sign: int, version: str, tokens: Column | str = "tokens") -> DataFrame:
    """Changes of one sign (+1 insert, -1 delete): source, lang, tokenizer_version, docs, tokens."""
    n = F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0)).cast("long")
    return counted.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer_version"),
                          F.lit(sign).cast("long").alias("docs"), (n * sign).alias("tokens"))


def revised(counted: DataFrame, old_version: str, old: str, new_version: str, new: str) -> DataFrame:
    """Changes that replace each row's count ``old`` by ``new``, possibly of another tokenizer version."""
    return signed(counted, -1, old_version, old).unionByName(signed(counted, 1, new_version, new))


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Committed batches under one folder of a store that all tasks share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _exists(self, path: str) -> bool:
        p = self._fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch_id: int) -> bool:
        return self._exists(f"{self.path}/batch={int(batch_id)}/_SUCCESS")

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Add a batch; False if it is there already."""
        if self.committed(batch_id):
            return False
        # a few rows: one file
        _sums(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch_id)}")
        return True

    def batches(self) -> DataFrame:
        """All committed rows, with their batch."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], f"batch int, {DDL}")
        fs = self._fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(self._fs.Path(self.path))]
        done = sorted(n for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{n}/_SUCCESS"))
        if not done:
            return self.spark.createDataFrame([], f"batch int, {DDL}")
        return self.spark.read.schema(f"{DDL}, batch int").option("basePath", self.path).parquet(*(f"{self.path}/{n}" for n in done))

    def totals(self) -> DataFrame:
        return _sums(self.batches()).filter("docs <> 0 or tokens <> 0").select(*KEYS, "docs", "tokens")
