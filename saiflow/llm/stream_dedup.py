"""Exact deduplication of a growing folder of documents by stateful streaming.

1. Ledger. A stream over the folder notes each row once: its identifier, the
   digest of its normalised text, and its locator (file and row number), which
   tells where the whole text stands.
2. State. A stateful stream over the ledger keeps, for each digest and without
   expiry, how many rows have it, and the identifier and locator of the row
   that stays (the greatest identifier). The state lies in RocksDB, on disk,
   with its checkpoint in the shared folder; digests that change are handed on
   batch by batch, each batch to a folder of its own, so a batch that is run
   again replaces what it wrote.
3. Hits. Every row whose digest other rows have too is read again and its full
   text compared with that of the row at the retained locator. Rows of a digest
   with any difference are told apart by their whole texts.

Steps 1 and 2 go on where they ended when ``ingest`` is called again after more
files came; ``decisions`` gives the state as it stands. Everything is built-in
functions and Spark's own streaming state.

Skew: rows of a digest are combined before their shuffle. Digests with more
than one in ``HOT`` of all rows, so at most ``HOT`` of them, are broadcast; the
others meet their rows in a shuffle join. The retained text of a large group
goes out once for every ``SHARE`` rows, which are dealt among these copies.

Defined results: a null text is the empty text; among rows of one identifier
the last by locator stays; a row without identifier stays only where no row of
the group has one; an empty folder gives no rows; other columns are ignored
and may have any names. Files must not change once they landed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import path_exists
from .common import native_perhaps, stage

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a partition's files are as long as what is in them, and a batch sends its changes alone to the checkpoint
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
HOT, SHARE = 1024, 1000
LEDGER = "doc_id long, digest binary, file string, row long"
LOCATOR = ["file", "row"]
STATE = "digest binary, n long, keep struct<doc_id:long,file:string,row:long>, batch int"


def lower_ascii(text: Column) -> Column:
    """The text with only A-Z in lower case; a null one is empty."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame) -> DataFrame:
    """``rows`` of Parquet files with where each stands."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


class Deduplicator:
    """Deduplicates the Parquet files at ``source``; ``home`` is a folder of the shared storage for ledger, state and checkpoints."""

    def __init__(self, spark: SparkSession, source: str, home: str, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int | None = None):
        self.spark, self.source, self.home = spark, source, home.rstrip("/")
        self.id_col, self.text_col, self.normalise, self.digest = id_col, text_col, normalise, digest
        self.files_per_batch = files_per_batch

    def _documents(self, reader) -> DataFrame:
        """doc_id, text and locator of every row at the source."""
        rows = located(reader.schema(self.schema).parquet(self._pattern()))
        return rows.select(F.col(self.id_col).cast("long").alias("doc_id"), self.normalise(F.col(self.text_col)).alias("text"),
                           F.col("_file").alias("file"), F.col("_row").alias("row"))

    def _pattern(self) -> str:
        """The source as a stream takes it: a folder, or a pattern that only the one file fits."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.source)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            return self.source
        folder, _, name = self.source.rstrip("/").rpartition("/")
        return f"{folder}/{{{name}}}"

    @property
    def schema(self):
        """Of the two columns that are read."""
        return self.spark.read.parquet(self.source).select(self.id_col, self.text_col).schema

    def _stream(self):
        reader = self.spark.readStream
        return reader.option("maxFilesPerTrigger", self.files_per_batch) if self.files_per_batch else reader

    def ingest(self) -> None:
        """Note and count what landed since the last call."""
        noted = self._documents(self._stream()).select("doc_id", self.digest(F.col("text")).alias("digest"), *LOCATOR)
        self._run(noted.writeStream.format("parquet").option("path", f"{self.home}/ledger"), "ledger")
        rows = self._stream().schema(LEDGER).parquet(f"{self.home}/ledger")
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", *LOCATOR)).alias("keep"))
        self._run(state.writeStream.outputMode("update").foreachBatch(self._hand_on), "state")

    def _hand_on(self, changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.home}/changes/batch={batch}")

    def _run(self, writer, name: str) -> None:
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in STATE_STORE}
        try:
            for key, value in STATE_STORE.items():
                conf.set(key, value)
            query = writer.option("checkpointLocation", f"{self.home}/checkpoint-{name}").trigger(availableNow=True).start()
        finally:
            for key, value in before.items():
                conf.set(key, value) if value is not None else conf.unset(key)
        query.awaitTermination()

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.home}/ledger")

    def state(self) -> DataFrame:
        """digest, n, keep: each digest as the last batch that changed it left it (its count only grows)."""
        path = f"{self.home}/changes"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], STATE).drop("batch")
        changes = self.spark.read.schema(STATE).parquet(path)
        return changes.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")).select("digest", "last.n", "last.keep")

    def _counted(self) -> DataFrame:
        """Each row of the ledger with the n and keep of its digest."""
        rows, state = self.ledger(), stage(self.spark, self.state(), "dedup-state")
        total = rows.count()
        hot = F.col("n") * HOT > total
        few = F.broadcast(state.filter(hot))
        by_few = rows.join(few, "digest")
        return by_few.unionByName(rows.join(few, "digest", "left_anti").join(state.filter(~hot), "digest"))

    def _differing(self, hits: DataFrame) -> DataFrame:
        """Digests of ``hits`` some of whose rows have not the bytes of the row that stays."""
        at = F.struct(*LOCATOR)
        documents = self._documents(self.spark.read).select("text", *LOCATOR)
        texts = stage(self.spark, native_perhaps(documents, hits, LOCATOR).join(hits, LOCATOR), "dedup-texts")
        if texts.count() != hits.count():
            raise ValueError(f"files at {self.source} changed or went since they were noted")
        copies = F.ceil(F.col("n") / SHARE).cast("int")
        kept = texts.filter(F.struct(*LOCATOR) == F.struct("keep.file", "keep.row"))
        kept = kept.select("digest", F.col("text").alias("retained"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("share"))
        dealt = texts.withColumn("share", F.pmod(F.xxhash64(at), copies).cast("int"))
        return dealt.join(kept, ["digest", "share"], "left").filter(~F.col("text").eqNullSafe(F.col("retained"))).select("digest").distinct()

    def decisions(self) -> DataFrame:
        """doc_id, file, row, digest, keep_id, group_size, kept of every row noted so far."""
        counted = stage(self.spark, self._counted(), "dedup-counted")
        hits = counted.filter("n > 1")
        differing = stage(self.spark, self._differing(hits.select("n", "digest", "keep", *LOCATOR)), "dedup-differing")
        mine = F.struct("doc_id", *LOCATOR)
        out = ["doc_id", *LOCATOR, "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (mine == F.col("keep")).alias("kept")]
        if differing.isEmpty():
            return counted.select(*out)
        odd = self._documents(self.spark.read).join(hits.join(differing, "digest", "left_semi").drop("doc_id", "n", "keep"), LOCATOR)
        same = Window.partitionBy("digest", "text")
        odd = odd.withColumns({"n": F.count(F.lit(1)).over(same), "keep": F.max(mine).over(same)})
        return counted.join(differing, "digest", "left_anti").select(*out).unionByName(odd.select(*out))
