"""Token ids in a compressed, parallel-readable file.

Layout below one folder, all written by Spark's committers:

* ``table``: the shared frequency table (token, freq), sums to 2^bits;
* ``blocks``: independent blocks of up to ``BLOCK_TOKENS`` ids of one shard, each
  with lanes, checkpoints, checksums and the pieces of documents it holds;
* ``shards``: ids in each shard and before it.

Shards follow the key's order, blocks follow each other in a shard, so the ids
of all blocks in (shard, block) order are the corpus in key order.  A document
longer than the rest of a block goes on in the next block as another piece.

Texts are tokenised once, into a scratch table that also gives the counts over
the whole corpus.  The frequency table has one row per token id in use, which
the vocabulary bounds; it is the only thing brought to the driver.

Defined cases: a NULL or empty text is the end id alone; a NULL key sorts first;
rows with equal keys are separate documents, ordered by their ids; an empty
table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from cohortloom.llm import rans
from cohortloom.llm.byte_pairs import encoder
from cohortloom.llm.common import join_small
from cohortloom.storage import bounded_batches, discard, scratch_path

BLOCK_TOKENS = 1 << 19
LANES = 2048
EVERY = 64
END_ID = 0
_SLICE_ROWS = 512


def tokenise(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``key``, ``ids`` (little-endian unsigned 32- or 16-bit, end id included), ``width``."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(tokenizer)
        end = np.array([end_id], dtype=worker.dtype).tobytes()
        gc.disable()  # nothing here makes cycles, and each full collection goes through the whole memo
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _SLICE_ROWS):
                    part = batch.slice(at, _SLICE_ROWS)
                    ids = [worker.encode(x) + end if x else end for x in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])
        finally:
            gc.enable()
            worker.forget()

    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _counts(ids: DataFrame, dtype: str) -> DataFrame:
    """Occurrences of each token id; tasks add up their own before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                together = b"".join(batch.column(0).slice(at, _SLICE_ROWS).to_pylist())
                own = np.bincount(np.frombuffer(together, dtype))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    return ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _block_schema(kind: T.DataType) -> T.StructType:
    pieces = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("doc", "at", "n"))])
    return T.StructType([
        *(T.StructField(c, T.IntegerType()) for c in ("shard", "block")), T.StructField("first", T.LongType()),
        *(T.StructField(c, T.IntegerType()) for c in ("n_tokens", "lanes", "every")),
        *(T.StructField(c, T.BinaryType()) for c in ("words", "states")),
        T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.LongType())),
        T.StructField("pieces", T.ArrayType(pieces)),
    ])


def _encode_blocks(ordered: DataFrame, table: rans.Table, dtype: str) -> DataFrame:
    kind = ordered.schema["key"].dataType
    schema = _block_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard = to_arrow_schema(schema), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        size = number = first = doc = 0

        def close() -> pa.RecordBatch:
            nonlocal held, pieces, size, number, first
            lanes = max(1, min(LANES, size // 64))
            b = rans.encode(np.concatenate(held), table, lanes, EVERY)
            row = {"shard": shard, "block": number, "first": first, "n_tokens": b.n, "lanes": lanes, "every": b.every,
                   "words": b.words, "states": b.states.astype("<u8").tobytes(), "offsets": b.offsets.tolist(),
                   "sums": b.sums, "pieces": pieces}
            held, pieces, first, number, size = [], [], first + b.n, number + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, at = np.frombuffer(raw.as_buffer(), dtype), 0
                while at < len(ids):
                    take = min(BLOCK_TOKENS - size, len(ids) - at)
                    pieces.append({"key": key, "doc": doc, "at": size, "n": take})
                    held.append(ids[at : at + take].astype(np.uint32))
                    size, at = size + take, at + take
                    if size == BLOCK_TOKENS:
                        yield close()
                doc += 1
        if size:
            yield close()

    return ordered.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Tokenise ``docs`` and write them in key order below ``path``."""
    with bounded_batches(docs.sparkSession):
        _write(docs, path, tokenizer, key, text, end_id)


def _write(docs: DataFrame, path: str, tokenizer: str, key: str, text: str, end_id: int) -> None:
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype
    scratch = scratch_path(spark, "token-ids")
    tokenise(docs, tokenizer, key, text, end_id).write.option("compression", "zstd").parquet(scratch)
    ids = spark.read.parquet(scratch)
    found = _counts(ids, dtype).toPandas().sort_values("token")  # at most one row per vocabulary entry
    symbols, counts = found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    bits = rans.table_bits(len(symbols))
    freq = rans.scaled_frequencies(symbols, counts, bits) if len(symbols) else counts
    rows = spark.createDataFrame(
        pa.table({"token": symbols, "freq": freq, "bits": np.full(len(symbols), bits, np.int32)}))
    rows.coalesce(1).write.parquet(f"{path}/table")
    table = rans.Table.of(symbols, freq, bits)
    tied = ids.withColumn("_tie", F.xxhash64("ids"))
    order = [F.asc_nulls_first("key"), F.asc("_tie"), F.asc("ids")]
    ordered = tied.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("key", "ids")
    _encode_blocks(ordered, table, dtype).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(ids)
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row per shard, which is one per range partition
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def _pieces(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """Decoded pieces of documents: shard, doc, key, start, n, crc32 and, if asked for, ids."""
    rows = spark.read.parquet(f"{path}/table").toPandas().sort_values("token")  # vocabulary-bounded
    bits = int(rows["bits"].iloc[0]) if len(rows) else 12
    table = rans.Table.of(rows["token"].to_numpy(np.int64), rows["freq"].to_numpy(np.int64), bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("before"))
    placed = join_small(blocks, shards, ["shard"], "inner")
    key = blocks.schema["pieces"].dataType.elementType["key"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("key", key),
        *(T.StructField(c, T.LongType()) for c in ("start", "n", "crc32")),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                states = np.frombuffer(row["states"], "<u8").astype(np.uint64).reshape(-1, row["lanes"])
                ids = rans.decode(rans.Block(row["n_tokens"], row["lanes"], row["every"], row["words"],
                                             np.array(row["offsets"], np.int64), states, row["sums"]), table)
                little, base, out = ids.astype("<u4"), row["before"] + row["first"], []
                for p in row["pieces"]:
                    own = little[p["at"] : p["at"] + p["n"]].tobytes()
                    out.append({"shard": row["shard"], "doc": p["doc"], "key": p["key"], "start": base + p["at"],
                                "n": p["n"], "crc32": zlib.crc32(own)} | ({"ids": own} if with_ids else {}))
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return placed.mapInArrow(run, schema)


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its parts.

    crc32 is affine: the crc of A and B is B's crc with A's crc carried over as
    many zero bytes as B is long, less what those zeros alone give.
    """
    total = 0
    for i, (own, size) in enumerate(parts):
        if i == 0:
            total = own
            continue
        zeros = bytes(min(size, 1 << 20))
        carried, plain, left = total, 0, size
        while left:
            step = min(left, len(zeros))
            carried, plain = zlib.crc32(zeros[:step], carried), zlib.crc32(zeros[:step], plain)
            left -= step
        total = carried ^ plain ^ own
    return total


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` and its number of pieces."""
    merged = _pieces(spark, path, False).groupBy("shard", "doc", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "crc32"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([p[0]["start"] for p in parts], pa.int64()),
                pa.array([sum(x["n"] for x in p) for p in parts], pa.int64()),
                pa.array([joined_crc32([(x["crc32"], 4 * x["n"]) for x in p]) for p in parts], pa.int64()),
                pa.array([len(p) for p in parts], pa.int32()),
            ], names=["key", "start", "n_tokens", "ids_crc32", "n_pieces"])

    kind = merged.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")),
                           T.StructField("n_pieces", T.IntegerType())])
    return merged.select("key", "parts").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), for training loops: key, start, n, ids."""
    return _pieces(spark, path, True).select("key", "start", "n", "ids")


def default_path(spark: SparkSession) -> str:
    """A new folder for one token file in the shared scratch space."""
    return os.path.join(scratch_path(spark, "token-file"))
