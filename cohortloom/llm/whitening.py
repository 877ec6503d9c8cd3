"""Whitening of embeddings on the leading eigenvectors of their covariance.

1. Every finite entry c becomes the whole number x = floor(64 c) + 1000000.
2. Sums and centred cross-products are whole numbers too: tasks add up their
   own, Spark adds the tasks', and the covariance is rounded once.  The result
   is the same for any partitioning and after any lost executor.
3. The spectrum is cut into intervals by inertia counts (``feast``); each
   interval is a task of its own that solves the shifted covariance around it.
   Only the d x d covariance and the vectors of the components pass the driver.
4. A Rayleigh-Ritz step over all intervals gives the components; the sum of the
   inertia counts is the number of pairs that must be there.
5. Rows are projected as matrix products, block by block, and the covariance of
   what was written is measured against the identity.

Defined cases: a row whose vector is NULL, empty or has an entry that is NULL, not
finite or too large for a 64-bit x is left out; so are rows whose length is not
the most common one (the greater of equally common ones); a NULL key is kept;
rows with equal keys or vectors are separate rows; directions whose variance is
below ``FLOOR`` of the largest are rounding noise and no components, so a table
of equal vectors, a single row or an empty table gives an empty result; a
``deviation`` too large for 64 bits is NULL; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortloom.llm import feast
from cohortloom.storage import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Least variance of a component, as a share of a bound of the largest.
FLOOR = 1e-11
_ROWS = 4096
_LIMIT = float(1 << 62)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column of length d as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fixed_point(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``x`` (array of long) of every row with a finite vector."""
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("x", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * values)
                bad = ~(np.abs(scaled) < _LIMIT)
            owner = np.repeat(np.arange(len(size)), size)
            good = (size > 0) & (np.bincount(owner[bad], minlength=len(size)) == 0)
            x = np.where(bad, 0, scaled).astype(np.int64)[good[owner]] + SHIFT
            ends = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["key", "x"])

    present = vectors.where(F.col(vector).isNotNull())
    return present.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, schema)


class _Sums:
    """Whole-number sums of arrays; Python numbers only where 64 bits might not do."""

    def __init__(self, shape: tuple[int, ...]):
        self.total, self.bound = np.zeros(shape, np.int64), 0

    def add(self, part: np.ndarray, bound: int) -> None:
        self.bound += bound
        if self.bound >= 1 << 62 or part.dtype == object:
            self.total = self.total.astype(object) + part.astype(object)
        else:
            self.total = self.total + part

    def decimals(self) -> pa.Array:
        return pa.array([Decimal(int(v)) for v in self.total.ravel()], pa.decimal128(38, 0))


def _column_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums((d + 1,))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.column(0).slice(at, _ROWS), d)
                top = max(1, int(np.abs(x).max())) * len(x)
                part = (x if top < 1 << 62 else x.astype(object)).sum(axis=0)
                sums.add(np.concatenate([part, np.array([len(x)], part.dtype)]), top)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), sums.decimals()], names=["i", "s"])

    found = rows.select("x").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = {r["i"]: int(r["s"]) for r in found}  # d + 1 rows
    return total.get(d, 0), [total.get(i, 0) for i in range(d)]


def _cross_products(rows: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Exact sums of (x - centre)(x - centre)' as an object matrix of whole numbers."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                y = _matrix(batch.column(0).slice(at, _ROWS), d) - centre
                top = max(1, int(np.abs(y).max())) ** 2 * len(y)
                if top < 1 << 53:  # every partial sum is a whole number that a double holds
                    real = y.astype(np.float64)
                    sums.add((real.T @ real).astype(np.int64), top)
                else:
                    exact = y.astype(object)
                    sums.add(exact.T @ exact, top)
        sums.total = sums.total[upper]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), sums.decimals()], names=["i", "j", "s"])

    found = rows.select("x").mapInArrow(run, "i long, j long, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((d, d), dtype=object)
    for r in found:  # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["s"])
    return out


class Whitening:
    """A fit: ``n``, ``sums``, ``covariance``, ``values`` (falling), ``vectors`` (columns), ``explained``."""

    def __init__(self, rows: DataFrame, d: int, components: int):
        self.n, self.sums = _column_sums(rows, d)
        n = self.n
        self.centre = np.array([s // n for s in self.sums], dtype=np.int64)
        self.rest = [s - n * (s // n) for s in self.sums]  # S = n * centre + rest
        products = _cross_products(rows, self.centre)
        exact = [[n * products[i, j] - self.rest[i] * self.rest[j] for j in range(d)] for i in range(d)]
        self.covariance = np.array([[v / (n * n) for v in row] for row in exact], dtype=np.float64)
        trace = sum(exact[i][i] for i in range(d)) / (n * n)
        self.values, self.vectors = self._components(rows, components)
        self.explained = self.values / trace if trace else self.values

    def _components(self, rows: DataFrame, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        matrix, spark = self.covariance, rows.sparkSession
        cuts = feast.intervals(matrix, wanted, FLOOR)
        if not cuts:
            return np.zeros(0), np.zeros((len(matrix), 0))
        shared = spark.sparkContext.broadcast(matrix)  # d x d

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for low, high, count in batch.itertuples(index=False):
                    _, vectors = feast.pairs(shared.value, low, high, count)
                    yield pd.DataFrame({"high": high, "vector": list(vectors.T)})

        table = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts), "high")
        found = table.mapInPandas(run, "high double, vector array<double>").orderBy(F.desc("high")).collect()  # at most d rows
        if len(found) != sum(c for *_, c in cuts):
            raise ArithmeticError("the intervals' pairs are not as many as their inertia counts")
        values, vectors = feast.joined(matrix, np.array([r["vector"] for r in found]).T)
        kept = min(wanted, len(found))
        return values[:kept], vectors[:, :kept]

    def project(self, rows: DataFrame) -> DataFrame:
        """``key``, ``deviation`` (sum of (n x - S)^2) and ``whitened`` (array) of every row."""
        d, n = len(self.sums), self.n
        centre, rest = self.centre, np.array(self.rest, dtype=object)
        turn, offset = self.vectors / np.sqrt(self.values), np.array([r / n for r in self.rest])
        schema = T.StructType([rows.schema["key"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    y = _matrix(part.column(1), d) - centre
                    gap = n * (max(1, int(np.abs(y).max())) + 1)
                    if gap * gap * d < 1 << 62:
                        far = ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
                    else:
                        far = [v if v < 1 << 63 else None for v in ((n * y.astype(object) - rest) ** 2).sum(axis=1)]
                    w = (y - offset) @ turn
                    ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(far, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))],
                        names=["key", "deviation", "whitened"])

        return rows.select("key", "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (divisor n) minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                w = _matrix(batch.column(0).slice(at, _ROWS), k)
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    found = whitened.select("whitened").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1, k + 1))
    for r in found:  # (k + 1) (k + 2) / 2 rows
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    n, mean = total[k, k], total[:k, k] / total[k, k]  # w was centred before it was projected
    return float(np.abs(total[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = materialize(fixed_point(vectors, key, vector), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), T.StructField("component", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("n", "deviation")]
                          + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")])
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not lengths:
        return nothing
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = Whitening(rows, d, components)
    k = len(fit.values)
    if not k:
        return nothing
    projected = materialize(fit.project(rows), "whitening-projected")
    error = identity_error(projected, k)
    share = F.element_at(F.array(*[F.lit(float(v)) for v in fit.explained]), F.col("component"))
    return (
        projected.select(F.col("key").alias(key), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
        .withColumn("component", F.col("_at") + 1)
        .select(key, "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"),
                F.lit(error).alias("identity_error"))
    )
