"""Quality classification by importance resampling.

Target text (labelled good) and raw text (all documents) each get a generative
model of hashed word n-grams: a bucket's share of all n-grams.  A document's
weight is the ratio of its likelihoods under the two models, so its log weight
is the sum of the log ratios of all its n-grams.  Gumbel noise drawn from its
key is added, and the top k documents are kept.  k is the share of good labels
times the number of documents.

N-grams are words (runs of letters and digits, or of other signs) and pairs of
neighbouring words; a word that repeats the one before gives one common bucket.
Counts of both models cover all documents.  Labels are looked up through a
broadcast sample of at most about ``MAX_LABELS`` labelled keys, picked by hash.

The k-th largest key is found by narrowing histograms over the whole table, so
no task sorts all documents.

Defined cases: a NULL or empty text has log weight 0; rows with a NULL key are
scored and share one noise; without any label everything is kept; an empty
table gives an empty result; ties at the k-th place are all kept; of repeated
labels of a key the worst counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortloom.functions import draws
from cohortloom.llm.shingles import term_hashes
from cohortloom.storage import bounded_batches, materialize

BUCKETS = 1 << 15
MAX_LABELS = 200_000
SMOOTHING = 10.0
_SLICE_ROWS = 512
_BINS = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and word pairs; bucket 0 is a repeated word."""
    own = term_hashes(text) if text else np.zeros(0, np.uint64)
    single = own * _MIX
    single ^= single >> np.uint64(31)
    pair = (own[:-1] * _MIX ^ own[1:]) * _MIX
    pair ^= pair >> np.uint64(29)
    out = np.concatenate([single, pair]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    out[len(own):][own[:-1] == own[1:]] = 0
    return out.astype(np.int64)


def label_sample(labels: DataFrame, good: Column, key: str = "doc_id", bound: int = MAX_LABELS) -> DataFrame:
    """``_key`` and ``_good``, one row per labelled key, about ``bound`` rows at most; picked by hash."""
    known = labels.where(good.isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(good).alias("_good"))
    total = known.count()
    parts = 1_000_000
    share = parts if total <= bound else parts * bound // total
    return known.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) < share)


def fit(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw model of every bucket; the sample's size is bounded by its maker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                for body, target in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = np.bincount(features(body), minlength=BUCKETS)
                    counts[0] += own
                    if target:
                        counts[1] += own
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])],
                                         names=["bucket", "raw", "target"])

    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key", "left")
    rows = (
        marked.select("_text", "_good").mapInArrow(run, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows at most
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    less = SMOOTHING * target.sum() / raw.sum()
    return (np.log((target + less) / (target.sum() + less * BUCKETS))
            - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)))


def score(docs: DataFrame, ratios: np.ndarray, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``n_features`` and ``log_weight`` of every row."""
    keep = [c for c in keep if c not in ("n_features", "log_weight", "gumbel_key", "kept")]
    sent = keep if text in keep else [*keep, text]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table = to_arrow_schema(schema), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                sizes, weights = [], []
                for body in part.column(sent.index(text)).to_pylist():
                    own = features(body)
                    sizes.append(len(own))
                    weights.append(float(table[own].sum()))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], schema=arrow)

    return docs.select(*sent).mapInArrow(run, schema)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a written column, by histograms of ``_BINS`` bins; None if k exceeds the rows."""
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or rows < k:
        return None
    above = 0
    while low < high:
        width = (high - low) / _BINS
        inside = df.where(F.col(column).between(low, high))
        if low + width == low:  # too close for bins
            return _last(inside, column, k - above)
        # one row per bin: its rows and its own range
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(_BINS - 1))
        bins = inside.groupBy(number.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b.bin):
            if above + b.n >= k:
                if (b.low, b.high) == (low, high):
                    return low if b.low == b.high else _last(inside, column, k - above)
                low, high = b.low, b.high
                break
            above += b.n
    return low


def _last(inside: DataFrame, column: str, k: int) -> float:
    """k-th largest among values too close to be told apart by bins: walk the distinct values downwards."""
    for value, n in inside.groupBy(column).count().orderBy(F.desc(column)).toLocalIterator():
        k -= n
        if k <= 0:
            return value
    return value


def _keyed(scored: DataFrame, key: str, seed: int) -> DataFrame:
    uniform = draws.uniform(seed, F.lit(0), F.col(key))
    noise = -F.log(-F.log((uniform * 4294967296.0 + 0.5) / 4294967296.0))
    return scored.withColumn("gumbel_key", F.col("log_weight") + noise)


def select(scored: DataFrame, share: float, key: str = "doc_id", seed: int = 7, wide: DataFrame | None = None) -> DataFrame:
    """Gumbel top-k: add ``gumbel_key`` and ``kept``; k is ``share`` of the rows.

    ``wide`` has the same rows with long columns: the bound is found on ``scored``, which is written, and
    ``wide`` is judged by it without being written.
    """
    keyed = materialize(_keyed(scored, key, seed), "importance-keys")
    k = round(share * keyed.count())
    bound = kth_largest(keyed, "gumbel_key", k)
    kept = F.lit(k > 0) if bound is None else F.col("gumbel_key") >= F.lit(bound)
    return (keyed if wide is None else _keyed(wide, key, seed)).withColumn("kept", kept)


def classify(docs: DataFrame, labels: DataFrame, good: Column, keep: Sequence[str] = ("doc_id",), key: str = "doc_id",
             text: str = "text", seed: int = 7) -> DataFrame:
    """``keep``, ``n_features``, ``log_weight``, ``gumbel_key`` and ``kept`` of every row.

    ``keep`` holds ``key``; a kept column with a result's name gives way to it.
    """
    with bounded_batches(docs.sparkSession):
        return _classify(docs, labels, good, keep, key, text, seed)


def _classify(docs: DataFrame, labels: DataFrame, good: Column, keep: Sequence[str], key: str, text: str, seed: int) -> DataFrame:
    sample = materialize(label_sample(labels, good, key), "importance-labels")
    share = sample.agg(F.avg(F.col("_good").cast("double"))).first()[0]
    ratios = fit(docs, sample, key, text)
    scored, wide = score(docs, ratios, keep, text), None
    if text in keep:  # texts are scored again rather than written
        scored, wide = score(docs, ratios, [key], text), scored
    return select(scored, 1.0 if share is None else share, key, seed, wide)
