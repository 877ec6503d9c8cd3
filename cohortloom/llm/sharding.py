"""Sharding by sampled splitters: ranges of a key that hold equal numbers of bytes.

1. The key is (hash of the text, hash of the id, row number), three 64-bit numbers:
   equal texts lie side by side, and any range can be cut further.
2. Rows are drawn with a chance in proportion to their size; quantiles of the
   drawn keys are the splitters.  A splitter is moved to the start of its group
   of equal texts, unless the group is itself more than a range.
3. Every range is measured exactly.  Overfull ranges get splitters of their own,
   drawn from their rows, until all ranges are small or hold a single row.
4. Neighbouring ranges are put together: a shard ends at the range end next to
   its share of all bytes, a piece (one file) after a bounded number of bytes.
5. One shuffle by piece moves the whole records; each piece is sorted and written
   below its shard, and its slots follow those of the pieces before it.

So shards differ by about one range, 1 / ``RANGES`` of a shard, or by the longest
record if that is more.  Only groups of equal texts larger than that are ever
divided between shards.  Draws, ranges and shards depend on the rows alone, not
on their partitioning.  Splitters are bounded by ``MAX_RANGES`` and the draws by
``DRAWS`` for each range; both are independent of the number of rows.

Defined cases: a NULL text is no bytes and a group of its own with the empty
text; NULL ids hash alike; rows equal in text and id are interchangeable but
hold slots of their own; records larger than a share may leave shards empty; an
empty table writes no file; other columns are written as they are, but a
caller's column with the name of one of the two new ones is left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from cohortloom.llm.common import join_small
from cohortloom.storage import discard, materialize, scratch_path

SHARDS = 24
#: Bytes that a record counts besides its text.
RECORD_BYTES = 8
#: Ranges aimed at in each shard, ranges in all, and draws for each range.
RANGES = 128
MAX_RANGES = 50_000
DRAWS = 16
#: A range is overfull beyond so many times its share of the bytes.
OVERFULL = 2
#: Most rows of a range and bytes of a piece; a piece of fewer than ``PIECES`` of a shard is not made.
RANGE_ROWS = 1 << 20
PIECE_BYTES = 256 << 20
PIECES = 8
_KEY = ["k1", "k2", "k3"]
_SIGN = 1 << 63
_ADDED = ("shard", "slot")


def _packed(*keys: np.ndarray) -> np.ndarray:
    """Keys of three signed numbers as 24 bytes that sort like them."""
    out = np.empty((len(keys[0]), 3), ">u8")
    for i, k in enumerate(keys):
        out[:, i] = np.asarray(k, np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return out.view("S24").ravel()


def _start(k1: int, k2: int = -_SIGN, k3: int = -_SIGN) -> bytes:
    return b"".join((k + _SIGN).to_bytes(8, "big") for k in (k1, k2, k3))


def _ranged(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """``rows`` with ``range``, the number of splitters at or before the key."""
    shared = rows.sparkSession.sparkContext.broadcast(b"".join(splitters))  # MAX_RANGES times a small factor

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cuts = np.frombuffer(shared.value, "S24")
        for keys in batches:
            yield pd.Series(np.searchsorted(cuts, _packed(*keys), side="right"))

    return rows.withColumn("range", place(*_KEY))


def _chosen(drawn: list, share: float) -> list[bytes]:
    """Splitters at every ``share`` of the drawn weight; groups of more than a share are cut out and cut inside."""
    drawn = sorted((r["k1"], r["k2"], r["k3"], r["weight"]) for r in drawn)
    groups: dict[int, float] = {}
    for k1, _, _, w in drawn:
        groups[k1] = groups.get(k1, 0.0) + w
    found, passed, due = set(), 0.0, share
    for k1, k2, k3, w in drawn:
        passed += w
        if passed >= due:
            due = (passed // share + 1) * share
            found.add(_start(k1, k2, k3) if groups[k1] > share else _start(k1))
            if groups[k1] > share:
                found.add(_start(k1))
                if k1 < _SIGN - 1:
                    found.add(_start(k1 + 1))
    return sorted(found)


def _drawn(rows: DataFrame, share: float, turn: int) -> list:
    """Rows drawn with chance size * DRAWS / share; one that exceeds it weighs as much as its size."""
    rate = F.col("size") * F.lit(DRAWS / share)
    u = F.pmod(F.xxhash64(F.lit(turn), *_KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.when(rate >= 1, F.col("size").cast("double")).otherwise(F.lit(share / DRAWS))
    return rows.where(u < rate).select(*_KEY, weight.alias("weight")).collect()


def splitters(rows: DataFrame, shards: int, ranges: int = RANGES) -> tuple[list[bytes], DataFrame]:
    """Splitters of ``rows`` (key and ``size``), and bytes and rows of every range that is not empty."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()[0]
    if not total["rows"]:
        return [], _measured(rows, [])
    most_rows = max(RANGE_ROWS, -(-total["rows"] * 2 // MAX_RANGES))
    wanted = min(MAX_RANGES, max(shards * ranges, -(-total["rows"] // most_rows) * 2))
    share = total["bytes"] / wanted
    cuts = _chosen(_drawn(rows, share, 0), share)
    turn = 0
    while True:
        measured = _measured(rows, cuts)
        full = measured.where((F.col("n") > 1) & ((F.col("bytes") > OVERFULL * share + F.col("longest")) | (F.col("n") > most_rows)))
        over = [r["range"] for r in full.select("range").collect()]  # a few of the ranges
        if not over:
            return cuts, measured
        turn += 1
        inside = _ranged(rows, cuts).join(F.broadcast(rows.sparkSession.createDataFrame([(r,) for r in over], "range long")), "range", "left_semi")
        # finer with every turn, so that a range of many small rows is cut as well
        finer = share / 2**turn
        more = sorted(set(cuts) | set(_chosen(_drawn(inside, finer, turn), finer)))
        if more == cuts and finer <= 1:
            return cuts, measured
        cuts = more


def _measured(rows: DataFrame, cuts: list[bytes]) -> DataFrame:
    sums = (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("longest"))
    return materialize(_ranged(rows, cuts).groupBy("range").agg(*sums), "shard-ranges")


def _plan(measured: DataFrame, shards: int) -> DataFrame:
    """``range``, ``shard``, ``part`` (piece of the shard), ``first`` (slot of the piece's first row)."""
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    whole = W.partitionBy(F.lit(0))
    placed = measured.withColumns({"before": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)), "total": F.sum("bytes").over(whole)})
    middle = (F.col("before") + F.col("bytes") / 2) * shards / F.col("total")
    placed = placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    inside = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    step = F.least(F.lit(float(PIECE_BYTES)), F.greatest(F.lit(1.0), F.col("total") / (shards * PIECES)))
    done = F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    placed = placed.withColumns({"part": F.floor(done / step), "slots": F.coalesce(F.sum("n").over(inside), F.lit(0))})
    return placed.select("range", "shard", "part", F.min("slots").over(W.partitionBy("shard", "part")).alias("first"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write the records below ``path`` in ``shards`` folders ``shard=N``, each record with its ``slot``."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in _ADDED]
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + RECORD_BYTES
    keyed = docs.select(
        F.struct(*own).alias("record"), F.xxhash64(body).alias("k1"), F.xxhash64(F.col(key).cast("string")).alias("k2"),
        # tells apart rows that are equal in text and id
        F.monotonically_increasing_id().alias("k3"), size.alias("size"))
    scratch = scratch_path(spark, "shard-rows")
    keyed.write.option("compression", "zstd").parquet(scratch)
    rows = spark.read.schema(keyed.schema).parquet(scratch)
    cuts, measured = splitters(rows.select(*_KEY, "size"), shards)
    plan = materialize(_plan(measured, shards), "shard-plan")
    placed = join_small(_ranged(rows.drop("size"), cuts), plan, ["range"], "inner")
    along = F.row_number().over(W.partitionBy("shard", "part").orderBy(*_KEY))
    out = placed.select("record.*", (F.col("first") + along - 1).cast("long").alias("slot"), "shard")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    discard(rows)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The written records with ``slot`` and ``shard``; ``schema`` is that of the documents."""
    own = [f for f in schema.fields if f.name.lower() not in _ADDED]
    full = T.StructType([*own, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(full).parquet(path)


def default_path(spark: SparkSession) -> str:
    """A new folder for one set of shards in the shared scratch space."""
    return os.path.join(scratch_path(spark, "shards"))
