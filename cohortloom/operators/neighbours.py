"""Exact nearest neighbours among vectors without emitting pairs.

Rows are put in the cell of their nearest pivot; small cells are bundled and large
ones cut, into blocks of bounded size.  A search inside the own block bounds each
row's k-th distance; the triangle inequality then rules out whole cells, by the
radius of each pivot.  Rows visit only the blocks with cells that are left, in
bounded chunks, and each visit returns k rows.  Inside a block a matrix product
finds the candidates, whose distances are then measured directly.
Pivots, and their radii, are the only list that tasks hold as a whole: about the
square root of the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cohortloom.storage import materialize

LEAST_PIVOTS = 64
_QUERIES_AT_ONCE = 256
_ROWS_AT_ONCE = 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # direct differences, one row at a time: exact zeros for equal vectors
    return np.stack([np.sqrt(((b - row) ** 2).sum(axis=1)) for row in a]) if len(a) else np.empty((0, len(b)))


def _candidates(source: np.ndarray, target: np.ndarray, asking: np.ndarray, names: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each source row the places of target rows, in order, that hold its k nearest others.

    Squares by a matrix product are off by rounding only, which the limit allows for;
    the caller measures what is left.
    """
    own, other = (source ** 2).sum(axis=1), (target ** 2).sum(axis=1)
    if len(target) <= 2 * k or not np.isfinite(own.sum() + other.sum()):
        yield from (np.arange(len(target)) for _ in source)
        return
    squares = other - 2 * (source @ target.T) + own[:, None]
    slack = 8 * (source.shape[1] + 4) * np.finfo(float).eps * (own + other.max())
    # k others are among the k + as many rows as bear the row's own name
    same = (names == asking[:, None]).sum(axis=1)
    for i, row in enumerate(squares):
        m = min(len(row), k + same[i]) - 1
        yield np.flatnonzero(row <= np.partition(row, m)[m] + 2 * slack[i])


def exact_neighbours(df: DataFrame, key: str, vector: str, k: int, block_rows: int = 8192,
                     pivots: int | None = None) -> DataFrame:
    """The k nearest other rows of every row: (key, rank, neighbour, distance).

    ``pivots``: by default the square root of the number of rows, 64 at least.
    Ties are broken by the neighbour's key.  Vectors must have equal length.
    """
    key_type = df.schema[key].dataType
    rows = df.select(key, F.col(vector).cast("array<double>").alias("_v"))
    total = rows.count()
    if pivots is None:
        pivots = max(LEAST_PIVOTS, math.isqrt(total))
    # picked by hash
    sample = rows.orderBy(F.xxhash64(key), key).limit(pivots).select("_v").collect()
    if not sample:
        return df.sparkSession.createDataFrame([], T.StructType([
            T.StructField(key, key_type), T.StructField("rank", T.IntegerType()),
            T.StructField("neighbour", key_type), T.StructField("distance", T.DoubleType())]))
    centers = np.array([r[0] for r in sample], dtype=float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(np.stack(pdf["_v"].to_numpy()), centers)
            yield pdf.assign(_cell=d.argmin(axis=1).astype("int32"), _d=d.min(axis=1))

    placed_schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()),
                                  T.StructField("_d", T.DoubleType())])
    placed = materialize(rows.mapInPandas(place, placed_schema), "knn-cells")
    # small cells whose pivots lie side by side share a bundle, large ones are cut into blocks
    sizes, radii = np.zeros(len(centers), dtype=np.int64), np.full(len(centers), -np.inf)
    for cell, count, radius in placed.groupBy("_cell").agg(F.count(F.lit(1)), F.max("_d")).collect():  # one row per pivot
        sizes[cell], radii[cell] = count, radius
    order = np.argsort(_distances(centers[:1], centers)[0], kind="stable")
    bundle, split, filled = np.zeros(len(centers), dtype=np.int32), [0], 0
    for cell in order:
        if filled and filled + sizes[cell] > block_rows:
            split.append(0)
            filled = 0
        bundle[cell] = len(split) - 1
        filled += int(sizes[cell])
        split[-1] = max(1, -(-filled // block_rows))
    parts = np.array(split, dtype=np.int32)
    bundles = df.sparkSession.createDataFrame(
        [(c, int(bundle[c]), int(parts[bundle[c]])) for c in range(len(centers))], "_cell int, _bundle int, _parts int")
    blocked = materialize(
        placed.join(F.broadcast(bundles), "_cell").select(  # one row per pivot
            key, "_v", "_cell", "_bundle", F.pmod(F.xxhash64(key), "_parts").cast("int").alias("_block")), "knn-blocks")
    first_cells = np.searchsorted(bundle[order], np.arange(len(parts)))

    near_schema = T.StructType([T.StructField(key, key_type), T.StructField("neighbour", key_type),
                                T.StructField("distance", T.DoubleType())])

    def nearest(query: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({key: [], "neighbour": [], "distance": []})
        if not len(query) or not len(data):
            return empty
        data = data.sort_values(key)
        names, asking = data[key].to_numpy(), query[key].to_numpy()
        target, source = np.stack(data["_v"].to_numpy()), np.stack(query["_v"].to_numpy())
        found_at, found_names, found_distances = [], [], []
        for first in range(0, len(source), _QUERIES_AT_ONCE):
            part = slice(first, first + _QUERIES_AT_ONCE)
            chosen = _candidates(source[part], target, asking[part], names, k)
            for i, near in enumerate(chosen, start=first):
                d = np.sqrt(((target[near] - source[i]) ** 2).sum(axis=1))
                d[names[near] == asking[i]] = np.inf
                best = np.argsort(d, kind="stable")[:k]
                best = best[np.isfinite(d[best])]
                found_at.append(np.full(len(best), i))
                found_names.append(names[near[best]])
                found_distances.append(d[best])
        return pd.DataFrame({key: asking[np.concatenate(found_at)], "neighbour": np.concatenate(found_names),
                             "distance": np.concatenate(found_distances)})

    own = blocked.drop("_cell").groupBy("_bundle", "_block").applyInPandas(lambda pdf: nearest(pdf, pdf), near_schema)
    own = materialize(own, "knn-own")
    reach = own.groupBy(key).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("_reach")
    )
    # rows alone in their block have no neighbour yet
    seekers = blocked.join(reach, key, "left").withColumn("_reach", F.coalesce("_reach", F.lit(float("inf"))))

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), _ROWS_AT_ONCE):
                some = pdf.iloc[low:low + _ROWS_AT_ONCE]
                d = _distances(np.stack(some["_v"].to_numpy()), centers)
                most = some["_reach"].to_numpy() * (1 + 1e-9) + 1e-12
                wanted = (d - radii <= most[:, None])[:, order]
                at, seen = np.nonzero(np.logical_or.reduceat(wanted, first_cells, axis=1))
                yield pd.DataFrame({key: some[key].to_numpy()[at], "_v": some["_v"].to_numpy()[at], "_bundle": seen.astype("int32"), "_parts": parts[seen],
                                    "_own_bundle": some["_bundle"].to_numpy()[at], "_own_block": some["_block"].to_numpy()[at]})

    integers = [T.StructField(c, T.IntegerType()) for c in ("_bundle", "_parts", "_own_bundle", "_own_block")]
    asked = seekers.select(key, "_v", "_reach", "_bundle", "_block").mapInPandas(visited, T.StructType([T.StructField(key, key_type), rows.schema["_v"], *integers]))
    visits = (
        asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .where((F.col("_bundle") != F.col("_own_bundle")) | (F.col("_block") != F.col("_own_block")))
        .select(key, "_v", "_bundle", "_block")
    )
    chunks = -(-total // block_rows)  # of the rows that may visit a block
    visits = visits.withColumn("_chunk", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(chunks)).cast("int"))
    hosts = blocked.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # own column names on the host side: both sides stem from the same blocks
    hosts = hosts.select(F.col(key).alias("_host"), F.col("_v").alias("_host_v"),
                         *[F.col(c).alias(f"{c}_at") for c in ("_bundle", "_block", "_chunk")])
    far = (
        visits.groupBy("_bundle", "_block", "_chunk")
        .cogroup(hosts.groupBy("_bundle_at", "_block_at", "_chunk_at"))
        .applyInPandas(lambda q, h: nearest(q, h.rename(columns={"_host": key, "_host_v": "_v"})), near_schema)
    )
    ordered = F.array_sort(F.collect_list(F.struct("distance", "neighbour")))
    return (
        own.unionByName(far).groupBy(key).agg(F.slice(ordered, 1, k).alias("_best"))
        .select(key, F.posexplode("_best").alias("_p", "_b"))
        .select(key, (F.col("_p") + 1).alias("rank"), F.col("_b.neighbour").alias("neighbour"),
                F.col("_b.distance").alias("distance"))
    )
