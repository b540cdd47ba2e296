"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature: a shingle's hash, permuted by a first permutation, names a place in
a circle of 2^20 places; a second permutation gives each place its value. The
k-th coordinate is the least value after shifting that permutation by k
places, so two permutations make all coordinates. Bands of consecutive
coordinates are hashed; sets that share a band meet.

Links are confirmed on the full shingle sets, in two steps, so that a group of
n copies costs about n comparisons instead of n * n:

1. each set is compared with the least set of each of its bands;
2. within a band, only sets that step 1 left in different components are
   compared, all of them, each pair in the first band that it shares and
   unless other links of that band join it already.

Sets whose signatures agree in too few coordinates to reach the threshold (by
``margin`` standard deviations) are not compared. A band with more than
``band_limit`` sets in several components is cut into blocks of about half as
many; each block of sets outside the band's largest component meets each block
of all its sets in a group of its own, so every pair of the band is still
examined and no task holds more than two blocks at a time.

Equal sets are one node. A pair of sets at the threshold is missed with
probability (1 - threshold ** rows) ** bands, about 5e-6 by default, and less
above it, whatever the size of its bands.

Defined results: a text that is null or without words has the empty set and
is linked with nothing; a text with fewer words than a shingle has its whole
word sequence as its one shingle; repeated rows are equal sets; rows without
id take the component of their set; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import perhaps, spread, stage
from .components import connected_components

PLACES = 1 << 20
#: What a row of a group stands for: the whole band is the group; or a set of the first block; or one of the second
#: block, outside the band's largest component or in it.
WHOLE, FEW, OUTSIDE, INSIDE = range(4)
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _M
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - size + 1)
    out = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(size, len(w))):
        out = _mixed(out * _K + h[k:k + n])
    return np.unique(out)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, for sorted distinct hashes; empty sets reach nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class CirculantMinHash:
    """Signatures of shingle sets from two permutations of the circle's places."""

    def __init__(self, coordinates: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.coordinates = coordinates
        self.first = rng.permutation(PLACES).astype(np.int32)
        second = rng.permutation(PLACES).astype(np.int32)
        circle = np.concatenate([second, second[:coordinates]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(circle, coordinates)  # row p: the values of place p under all shifts

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = np.unique(self.first[(hashes >> np.uint64(44)).astype(np.int64)])
        out = np.full(self.coordinates, PLACES, np.int32)
        for k in range(0, len(places), 256):
            np.minimum(out, self.shifted[places[k:k + 256]].min(axis=0), out=out)
        return out


@lru_cache(maxsize=2)
def _hasher(coordinates: int) -> CirculantMinHash:
    return CirculantMinHash(coordinates)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the shingle set (a, b), n_shingles, a byte of each coordinate, band hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_shingles", pa.int64()),
                        ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(bands * rows)
        salt = np.arange(bands, dtype=np.uint64) * _K
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingle_set(text, size)
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    a, b = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                    if not len(s):
                        out.append((doc, a, b, 0, b"", []))
                        continue
                    sig = hasher.signature(s)
                    h = salt
                    for k in sig.reshape(bands, rows).T.astype(np.uint64):
                        h = _mixed(h * _K + k + np.uint64(1))
                    low = _mixed(sig.astype(np.uint64) * _K).astype(np.uint8)
                    out.append((doc, a, b, len(s), low.tobytes(), h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(make, "doc_id long, a long, b long, n_shingles long, sig binary, bands array<long>"))


def least_agreement(coordinates: int, percent: int, margin: float) -> int:
    """Coordinates that must agree for a pair to be compared."""
    p = percent / 100
    return int(coordinates * p - margin * (coordinates * p * (1 - p)) ** 0.5)


def _alike(pairs: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose signatures and sizes allow the threshold."""
    one = nodes.select(F.col("node").alias("u"), F.col("sig").alias("su"), F.col("n_shingles").alias("nu"))
    two = nodes.select(F.col("node").alias("v"), F.col("sig").alias("sv"), F.col("n_shingles").alias("nv"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            su, sv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("su", "sv"))
            ok = pa.array((su == sv).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    near = pairs.join(one, "u").join(two, "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return near.select("u", "v", "su", "sv").mapInArrow(agree, "u long, v long")


def _texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes (distinct)."""
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).filter("node is not null")
    return perhaps(rows, ids).join(ids, "node", "left_semi").dropDuplicates(["node"])


def _confirm(spark: SparkSession, pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold. ``texts``: node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in batches:
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            tu, tv, ok = b.column("tu"), b.column("tv"), []
            for k, v in enumerate(vs):
                if v != last:
                    last, kept = v, shingle_set(tv[k].as_py(), size)
                ok.append(jaccard_at_least(shingle_set(tu[k].as_py(), size), kept, percent))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(us, ok) if y], pa.int64()),
                                              pa.array([x for x, y in zip(vs, ok) if y], pa.int64())], ["u", "v"])

    both = (pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v"))
    return stage(spark, both.select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long"), "near-links")


class _Group:
    """The sets of one band that lie in several components, or two blocks of them, and the pairs to compare here."""

    def __init__(self, rows: list[dict], least: int, percent: int):
        self.rows, self.least, self.percent = rows, least, percent
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.component = np.unique([r["component"] for r in rows], return_inverse=True)[1]
        self.size = np.array([r["n_shingles"] for r in rows], np.int64)
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.band = rows[0]["band"]
        # every pair has an end outside the band's largest component
        if rows[0]["side"] == WHOLE:
            self.outside = self.component != np.bincount(self.component).argmax()
            self.few, self.all = np.flatnonzero(self.outside), np.arange(len(rows))
        else:
            side = np.array([r["side"] for r in rows])
            self.outside = side != INSIDE
            self.few, self.all = np.flatnonzero(side == FEW), np.flatnonzero(side != FEW)

    def pairs(self, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components whose signatures and sizes allow the threshold, each only in
        the band that they share first."""
        for at in range(0, len(self.few), 64):
            i = self.few[at:at + 64]
            for lo in range(0, len(self.all), block):
                j = self.all[lo:lo + block]
                ok = self.component[i][:, None] != self.component[j][None, :]
                ok &= (self.node[i][:, None] < self.node[j][None, :]) | ~self.outside[j][None, :]
                n, m = self.size[i][:, None], self.size[j][None, :]
                ok &= 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
                x, y = np.nonzero(ok)
                for k in range(0, len(x), 1 << 13):
                    a, b = i[x[k:k + (1 << 13)]], j[y[k:k + (1 << 13)]]
                    near = (self.sig[a] == self.sig[b]).sum(axis=1) >= self.least
                    a, b = a[near], b[near]
                    shared = self.bands[a] == self.bands[b]
                    own = shared[:, self.band] & ~shared[:, :self.band].any(axis=1)
                    if own.any():
                        yield a[own], b[own]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each key, of batches sorted by key."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key and rows:
                yield rows
                rows = []
            key = r["key"]
            rows.append(r)
    if rows:
        yield rows


def _to_compare(members: DataFrame, parts: int, least: int, percent: int) -> DataFrame:
    """(key, node) of the members that are an end of a pair to compare."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            ends = np.zeros(len(rows), bool)
            for a, b in _Group(rows, least, percent).pairs() if len(rows) > 1 else ():
                ends[a] = ends[b] = True
            at = np.flatnonzero(ends).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0]["key"]] * len(at), pa.int64()),
                                                  pa.array([rows[k]["node"] for k in at], pa.int64())], ["key", "node"])

    return members.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(find, "key long, node long")


def _compare(members: DataFrame, parts: int, least: int, percent: int, size: int) -> DataFrame:
    """Links (u, v) among members that carry their text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            sets: dict[int, np.ndarray] = {}
            group = _Group(rows, least, percent)
            of = group.component.tolist()
            parent = list(range(len(rows)))  # of components

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            links = []
            for a, b in group.pairs():
                for x, y in zip(a.tolist(), b.tolist()):
                    if root(of[x]) == root(of[y]):  # already linked through others
                        continue
                    for k in (x, y):
                        if k not in sets:
                            sets[k] = shingle_set(rows[k]["text"], size)
                    if jaccard_at_least(sets[x], sets[y], percent):
                        parent[root(of[x])] = root(of[y])
                        links.append((rows[x]["node"], rows[y]["node"]))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return members.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(check, "u long, v long")


def _mixed_bands(members: DataFrame, band_limit: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, band, node, component) of bands with several components: those that fit a task, and those that do not."""
    size = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    mixed = size.filter("c0 <> c1").select("key", (F.col("n") > band_limit).alias("large"))
    rows = members.join(mixed, "key")
    return rows.filter(~F.col("large")).drop("large"), rows.filter("large").drop("large")


def _block_pairs(large: DataFrame, band_limit: int) -> DataFrame:
    """Members of large bands in groups of two blocks of about ``band_limit`` / 2: one of sets outside the band's
    largest component, one of all its sets. Each such pair of blocks is a key of its own."""
    half = max(1, band_limit // 2)
    counted = large.groupBy("key", "component").agg(F.count("*").alias("n"))
    bands = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    bands = bands.select("key", F.col("most.component").alias("largest"), F.ceil(F.col("n") / half).cast("int").alias("blocks"),
                         F.ceil((F.col("n") - F.col("most.n")) / half).cast("int").alias("few_blocks"))
    rows = large.join(bands, "key").withColumn("out", F.col("component") != F.col("largest"))

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(23), F.col("node")), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    few = rows.filter("out").withColumn("i", own("few_blocks")).withColumn("j", each("blocks")).withColumn("side", F.lit(FEW))
    every = (rows.withColumn("j", own("blocks")).withColumn("i", each("few_blocks"))
             .withColumn("side", F.when(F.col("out"), F.lit(OUTSIDE)).otherwise(F.lit(INSIDE))))
    return few.unionByName(every).select(F.xxhash64("key", "i", "j").alias("key"), "band", "node", "component", "side")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, bands: int = 40, rows: int = 6, margin: float = 5.0, band_limit: int = 5_000) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (it is that id) of each row of ``docs``."""
    signed = stage(spark, signatures(docs, id_col, text_col, shingle_words, bands, rows), "minhash")
    filled = signed.filter("n_shingles > 0")
    nodes = (filled.filter("doc_id is not null").groupBy("a", "b")
             .agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands"))))
    nodes = stage(spark, nodes, "minhash-nodes")

    # bands that several sets share
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stage(spark, banded.join(shared, "key").select("key", "band", "node", "least"), "minhash-bands")

    # step 1: every set with the least set of each of its bands
    least = least_agreement(bands * rows, percent, margin)
    narrow = nodes.select("node", "n_shingles", "sig")
    stars = stage(spark, members.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "minhash-met")
    met = stars.select(F.col("u").alias("node")).union(stars.select(F.col("v").alias("node")))
    stars = stage(spark, _alike(stars, perhaps(narrow, met), least, percent), "minhash-stars")
    ends = stars.select(F.col("u").alias("node")).union(stars.select(F.col("v").alias("node"))).distinct()
    links = _confirm(spark, stars, stage(spark, _texts_of(ends, docs, id_col, text_col), "minhash-texts"), shingle_words, percent)
    parts = stage(spark, connected_components(spark, links), "minhash-components")

    # step 2: sets of one band that are left in different components
    left = (members.join(parts, "node", "left")
            .select("key", "band", "node", F.coalesce("component", "node").alias("component")))
    work, large = _mixed_bands(left, band_limit)
    work = work.withColumn("side", F.lit(WHOLE))
    if not large.isEmpty():
        work = work.unionByName(_block_pairs(large, band_limit))
    work = stage(spark, work, "minhash-mixed")
    full = work.join(perhaps(nodes.select("node", "n_shingles", "sig", "bands"), work), "node")
    wanted = stage(spark, _to_compare(full, spread(spark), least, percent), "minhash-ends")
    texts = _texts_of(wanted.select("node").distinct(), docs, id_col, text_col)
    held = full.join(wanted, ["key", "node"], "left_semi").join(texts, "node")
    more = stage(spark, _compare(held, spread(spark), least, percent, shingle_words), "minhash-more")
    parts = connected_components(spark, links.unionByName(more)) if not more.isEmpty() else parts

    of_set = nodes.select("a", "b", "node").join(parts, "node", "left").select("a", "b", F.coalesce("component", "node").alias("_c"))
    joined = signed.select("doc_id", "n_shingles", "a", "b").join(of_set, ["a", "b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id"))
    return (joined.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least id, of equal ids any one. Rows without id stay.

    Rows are told apart by a number of their own, so two texts that share an id are two rows, each judged by its text.
    """
    rows = stage(spark, docs.withColumn("_mh_row", F.monotonically_increasing_id()), "minhash-numbered")
    found = near_duplicates(spark, rows, id_col="_mh_row", **options).select(F.col("doc_id").alias("_mh_row"), F.col("component_id").alias("_mh_group"))
    grouped = rows.select("_mh_row", F.col(id_col).alias("_mh_id")).filter("_mh_id is not null").join(found, "_mh_row")
    first = grouped.groupBy("_mh_group").agg(F.min(F.struct("_mh_id", "_mh_row")).alias("least"))
    stay = first.select(F.col("least._mh_row").alias("_mh_row")).unionByName(rows.filter(F.col(id_col).isNull()).select("_mh_row"))
    return rows.join(stay, "_mh_row", "left_semi").select(*docs.columns)
