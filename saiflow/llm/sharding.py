"""Histogram sort: rows dealt to shards by key ranges of near-equal bytes, in one exchange.

Splitters are found by counting, not by moving rows: each round counts the
exact bytes below equally spaced probe keys of every interval that still holds
a splitter, then keeps the sub-interval around each splitter, until the
interval is within the tolerance or holds so few rows that its keys are read.
One round is one aggregate over a narrow table (combined before its shuffle);
only the counts of at most ``probes`` sub-intervals per open interval come
back. Then every row knows its range, and rows are exchanged once.

The sort key is (hash of the text, id): equal texts are neighbours, and a text
that a third of all rows hold is still cut, by id. Ranges are finer than
shards (``pieces`` ranges to a shard), so that rows are ordered and numbered
inside a shard by many tasks.

Law "bytes": the sizes of shards are near equal; each boundary is the row
boundary nearest to its target.

Defined results: a null text has size 1 and the checksum of no bytes; a null
id sorts first; repeated rows share a key, stay on one side of a boundary and
are numbered in any order; an empty table gives no rows; other columns are
kept by ``histogram_sort``, but for size, text_crc32, shard and slot, which are
replaced (names that start with "_hs_" are its own).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

ROOM = (1 << 63) - 1
LEAST = -(1 << 63)
CELL_SHIFT = 51  # 4096 cells of the hash's leading 12 bits


@dataclass
class Interval:
    """Keys from ``low`` to ``high`` (of the hash, or of the id where ``hash`` is set), what lies below, and its splitters."""

    low: int
    high: int
    below_bytes: int
    below_rows: int
    bytes: int
    rows: int
    targets: list[int]
    hash: int | None = None


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add size, text_crc32 and the key (_hs_hash from 0 to 2^63 - 1, _hs_id)."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return (docs.withColumn("size", F.octet_length(body).cast("long") + 1).withColumn("text_crc32", F.crc32(body))
            .withColumn("_hs_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(ROOM)))
            .withColumn("_hs_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))))


def _cell():
    return F.shiftrightunsigned("_hs_hash", CELL_SHIFT).cast("int")


def _first_round(keys: DataFrame) -> list[tuple]:
    """Exact counts below 4096 equally spaced hashes: (low, high, bytes, rows) of every cell."""
    cells = keys.groupBy(_cell()).agg(F.min("_hs_hash").alias("lo"), F.max("_hs_hash").alias("hi"), F.sum("size").alias("b"), F.count("*").alias("r"))
    return sorted((r.lo, r.hi, r.b, r.r) for r in cells.collect())


def _next_round(spark: SparkSession, keys: DataFrame, open_: list[Interval], probes: int) -> list[list[tuple]]:
    """The same counts for ``probes`` equal parts of every open interval. Each lies within one cell,
    and there are at most as many as splitters, so their table is broadcast."""
    rows = [f"({n}, {(i.low if i.hash is None else i.hash) >> CELL_SHIFT}, {'null' if i.hash is None else i.hash}L, "
            f"{i.low}BD, {i.high}BD, {max(1, -(-(i.high - i.low + 1) // probes))}BD)".replace("nullL", "null") for n, i in enumerate(open_)]
    table = spark.sql(f"SELECT n, cell, cast(hash AS long) hash, cast(low AS decimal(20,0)) low, cast(high AS decimal(20,0)) high, "
                      f"cast(width AS decimal(20,0)) width FROM VALUES {', '.join(rows)} AS t(n, cell, hash, low, high, width)")
    key = F.when(F.col("hash").isNull(), F.col("_hs_hash")).otherwise(F.col("_hs_id"))
    wide = key.cast("decimal(20,0)")  # differences of longs may overflow
    inside = (keys.withColumn("cell", _cell()).join(F.broadcast(table), "cell")
              .filter(F.col("hash").isNull() | (F.col("hash") == F.col("_hs_hash"))).filter((wide >= F.col("low")) & (wide <= F.col("high"))))
    counted = (inside.groupBy("n", F.floor((wide - F.col("low")) / F.col("width")).alias("part"))
               .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("size").alias("b"), F.count("*").alias("r")))
    out: list[list[tuple]] = [[] for _ in open_]
    for r in counted.collect():
        out[r.n].append((r.lo, r.hi, r.b, r.r))
    return [sorted(x) for x in out]


def _after(high: int, hash_: int | None) -> tuple[int, int]:
    """The least key above all rows at ``high``."""
    if hash_ is None:
        return high + 1, LEAST
    return (hash_, high + 1) if high < ROOM else (hash_ + 1, LEAST)


def find_splitters(spark: SparkSession, keys: DataFrame, shares: int, tolerance: float = 0.0, probes: int = 4096) -> list[tuple[int, int, int]]:
    """Splitters between ``shares`` ranges of near-equal bytes, as (hash, id, rows below); a row belongs
    to the range right of a splitter if its key is at or above it.

    ``tolerance`` is a share of the mean range's bytes; 0 asks for the nearest row boundary.
    """
    cells = _first_round(keys)
    total = sum(c[2] for c in cells)
    targets = [total * t // shares for t in range(1, shares)]
    slack = tolerance * total / shares
    found: dict[int, tuple[int, int, int]] = {}

    def narrow(parts: list[tuple], whole: Interval) -> list[Interval]:
        """Settle the splitters whose part is fine enough; return the other parts."""
        out, bytes_, rows, waiting = [], whole.below_bytes, whole.below_rows, whole.targets
        for lo, hi, b, r in parts:
            own = [t for t in waiting if targets[t] <= bytes_ + b]
            waiting = waiting[len(own):]
            one_key = lo == hi and (whole.hash is not None or r == 1)
            if own and (one_key or b <= slack):
                start, end = ((lo, LEAST) if whole.hash is None else (whole.hash, lo)), _after(hi, whole.hash)
                for t in own:  # the nearer end
                    left = targets[t] - bytes_ <= bytes_ + b - targets[t]
                    found[t] = (*start, rows) if left else (*end, rows + r)
            elif own and lo == hi:  # one hash, many rows: go on by id
                out.append(Interval(LEAST, ROOM, bytes_, rows, b, r, own, hash=lo))
            elif own:
                out.append(Interval(lo, hi, bytes_, rows, b, r, own, whole.hash))
            bytes_, rows = bytes_ + b, rows + r
        return out

    open_ = narrow(cells, Interval(0, ROOM, 0, 0, total, sum(c[3] for c in cells), list(range(len(targets)))))
    while open_:
        open_ = [x for parts, i in zip(_next_round(spark, keys, open_, probes), open_) for x in narrow(parts, i)]
    return [found[t] for t in sorted(found)]


def _range_of(splitters: list[tuple[int, int, int]]):
    """Number of splitters at or below a row's key: those of lower cells, known by cell, and those compared in its own."""
    near: list[list[dict]] = [[] for _ in range(1 << (63 - CELL_SHIFT))]
    last = []
    for h, i, _ in splitters:
        (near[h >> CELL_SHIFT] if h <= ROOM else last).append({"h": h, "i": i})
    rows, below = [], 0
    for own in near:
        rows.append({"below": below, "near": own})
        below += len(own)
    cells = F.from_json(F.lit(json.dumps(rows)), "array<struct<below:int,near:array<struct<h:bigint,i:bigint>>>>")
    cell = F.element_at(cells, _cell() + 1)
    under = F.filter(cell["near"], lambda p: (p["h"] < F.col("_hs_hash")) | ((p["h"] == F.col("_hs_hash")) & (p["i"] <= F.col("_hs_id"))))
    return cell["below"] + F.size(under)


def histogram_sort(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   tolerance: float = 0.0, probes: int = 4096, rows_per_piece: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` with size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless in its shard, in key order)."""
    keyed = with_key(docs, id_col, text_col)
    keys = stage(spark, keyed.select("size", "_hs_hash", "_hs_id"), "shard-keys")
    pieces = min(64, max(8, -(-keys.count() // (shards * rows_per_piece))))
    splitters = find_splitters(spark, keys, shards * pieces, tolerance, probes)
    below = [0] + [s[2] for s in splitters]
    from_shard = ",".join(str(b - below[k - k % pieces]) for k, b in enumerate(below))
    offset = F.element_at(F.split(F.lit(from_shard), ",").cast("array<bigint>"), F.col("_hs_range") + 1)
    order = Window.partitionBy("_hs_range").orderBy("_hs_hash", "_hs_id", "text_crc32")
    return (keyed.withColumn("_hs_range", _range_of(splitters))
            .withColumn("slot", F.row_number().over(order).cast("long") - 1 + offset)
            .withColumn("shard", F.floor(F.col("_hs_range") / pieces).cast("int"))
            .drop("_hs_hash", "_hs_id", "_hs_range"))
