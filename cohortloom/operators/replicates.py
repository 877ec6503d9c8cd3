"""Sums and fits of all replicates of a resample, without a row per replicate.

A task holds the weights, or places, of some rows in some replicates as arrays and
returns one row of sums per replicate; rows are spread over the tasks, and
Spark adds up what the tasks return.  The draws are those of ``functions.draws``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cohortloom.functions import draws
from cohortloom.operators import linmod
from cohortloom.operators.ranks import SLICE, number_rows, rows_per_slice, value_slices
from cohortloom.storage import materialize

ROWS_PER_TASK = 16384
#: Outcomes a task holds at once.
OUTCOMES = 1 << 23
_HELD = 1 << 22  # numbers a task keeps before it hands them on
_ROWS_AT_ONCE = 256
_KEYS_AT_ONCE = 4096
_WEIGHTS_HELD = 1 << 24  # pairs of weights a task unpacks at once
_STRETCH = 256
_LEAST_ROWS = 512
_DRAWN_AT_ONCE = 32768  # digests
_ROWS_IN_PRODUCT = 4096
_PERMUTED_PER_TASK = 1 << 17
_PERMUTED_AT_ONCE = 8192
_TERMS = 400  # sums of a power series at most
_SUMS_IN_ROW = 40


def _dealt(rows: DataFrame, name: str, by: str, most: int = ROWS_PER_TASK) -> DataFrame:
    """``rows``, written once and spread over tasks of ``most`` rows, or fewer if some would be idle."""
    stored = materialize(rows, name)
    size = stored.count()
    cores = min(stored.sparkSession.sparkContext.defaultParallelism, -(-size // _LEAST_ROWS))
    return stored.repartition(max(1, cores, -(-size // most)), by)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _key_draws(column: pa.ChunkedArray, seed: int, blocks: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Weights of the rows of a column of key texts: places of some replicates among those of ``blocks``, and (replicates, rows)."""
    coded = column.combine_chunks().dictionary_encode()
    texts = [t.encode() for t in coded.dictionary.to_pylist()]
    place = coded.indices.to_numpy()
    sizes = np.array([len(t) for t in texts])
    parts = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        parts.append((at, np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), size)))
    digits = np.array([len(str(block)) for block in blocks])
    step, four = max(1, _DRAWN_AT_ONCE // max(len(texts), len(place))), draws.DRAWS_PER_DIGEST
    first = 0
    while first < len(blocks):
        last = min(first + step, int(np.searchsorted(digits, digits[first], side="right")))
        out = np.empty((last - first, four, len(texts)), np.uint8)
        for at, keys in parts:
            out[:, :, at] = draws.poisson_weights(seed, blocks[first:last].tolist(), keys)
        yield slice(first * four, last * four), out.reshape(-1, len(texts))[:, place]
        first = last


def bootstrap_sums(df: DataFrame, n: int, seed: int, key: Sequence[str], values: Mapping[str, Column],
                   by: Sequence[str] = (), replicate: str = "b") -> DataFrame:
    """``by``, ``replicate``, ``n`` and the weighted sums of ``values`` in the Poisson bootstrap of the rows.

    The weights are those of ``resample.bootstrap_rows``; groups without a row in a
    replicate are left out there.  ``values`` must not be NULL.
    """
    by, names, width = list(by), list(values), len(values) + 1
    groups = [f"_by{i}" for i in range(len(by))]
    rows = _dealt(df.select(
        *[F.col(c).alias(g) for c, g in zip(by, groups)], draws.key_text(*[F.col(k) for k in key]).alias("_key"),
        F.array(F.lit(1.0), *[values[c].cast("double") for c in names]).alias("_v")), "bootstrap-rows", "_key")
    added = _weighted_sums(rows, groups, n, seed, width, lambda chunk: _matrix(chunk["_v"], width))
    return added.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], F.col("_b").alias(replicate), F.col("_s0").alias("n"),
                        *[F.col(f"_s{i + 1}").alias(c) for i, c in enumerate(names)])


def _weighted_sums(rows: DataFrame, groups: Sequence[str], n: int, seed: int, width: int,
                   values_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``groups``, ``_b`` and the sums ``_s0``, ``_s1``, ... over dealt rows, by the weights drawn for ``_key``, of what ``values_of`` makes of them.

    The first of the ``width`` values of a row is 1.  More than ``_SUMS_IN_ROW`` sums are cut into rows of so many, numbered by ``_part``.
    """
    across = min(width, _SUMS_IN_ROW)
    cuts = range(0, width, across)
    blocks = -(-n // draws.DRAWS_PER_DIGEST)
    most = max(1, _HELD // (n * width))  # groups held at once
    schema = T.StructType([*[rows.schema[g] for g in groups], T.StructField("_b", T.IntegerType()), T.StructField("_part", T.IntegerType()),
                           *[T.StructField(f"_s{i}", T.DoubleType()) for i in range(across)]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def emit() -> Iterator[pa.RecordBatch]:
            for group, total in held.items():
                b = np.flatnonzero(total[:n, 0] > 0)
                labels = [pa.array([v] * len(b), kind) for v, kind in zip(group, kinds)]
                for part, first in enumerate(cuts):
                    columns = [pa.array(b.astype(np.int32)), pa.array(np.full(len(b), part, np.int32))]
                    columns += [pa.array(total[b, i] if i < width else np.zeros(len(b))) for i in range(first, first + across)]
                    yield pa.RecordBatch.from_arrays([*labels, *columns], names=schema.names)
            held.clear()

        for chunk in _chunks(batches, ROWS_PER_TASK if groups else _ROWS_IN_PRODUCT):
            kinds = [chunk.schema.field(g).type for g in groups]
            v = values_of(chunk)
            known: dict[tuple, int] = {}
            columns = [chunk[g].to_pylist() for g in groups]
            code = np.array([known.setdefault(g, len(known)) for g in zip(*columns)] if groups else [known.setdefault((), 0)] * len(v))
            order = np.argsort(code, kind="stable")
            v, code = v[order], code[order]
            starts = np.searchsorted(code, np.arange(len(known) + 1))
            plain = np.isfinite(v).all()
            labels = list(known)
            for first in range(0, len(labels), most):
                last = min(first + most, len(labels))
                part = slice(starts[first], starts[last])
                at, inside = starts[first:last] - starts[first], v[part]
                total = np.empty((last - first, blocks * draws.DRAWS_PER_DIGEST, width))
                for some, weights in _key_draws(chunk["_key"].take(pa.array(order[part])), seed, np.arange(blocks)):
                    w = weights.astype(float)
                    if plain and len(at) <= 64:
                        for g, (low, high) in enumerate(zip(at, [*at[1:], len(inside)])):
                            total[g, some] = w[:, low:high] @ inside[low:high]
                    else:
                        each = np.where(w[:, :, None] > 0, w[:, :, None] * inside, 0.0)
                        total[:, some] = np.add.reduceat(each, at, axis=1).swapaxes(0, 1)
                for label, found in zip(labels[first:last], total):
                    if label in held:
                        held[label] += found
                    else:
                        held[label] = found
                if groups and len(held) >= most:
                    yield from emit()
        yield from emit()

    keys = [*groups, "_b", *(["_part"] if len(cuts) > 1 else [])]
    return rows.mapInArrow(sums, schema).groupBy(*keys).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(across)])


def bootstrap_moments(df: DataFrame, n: int, seed: int, key: Sequence[str], columns: Sequence[str],
                      by: Sequence[str] = (), replicate: str = "b") -> DataFrame:
    """``linmod.weighted_moments`` of ``resample.bootstrap_rows`` by group and replicate."""
    values = {f"s_{c}": F.col(c) for c in columns}
    values |= {f"s_{a}|{b}": F.col(a) * F.col(b) for a, b in itertools.combinations_with_replacement(columns, 2)}
    sums = bootstrap_sums(df.dropna(subset=list(columns)), n, seed, key, values, by, replicate)
    return linmod.moments_of_sums(sums, [*by, replicate], columns)


def _smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them exactly."""
    for kind in (np.int8, np.float32):
        with np.errstate(all="ignore"):
            if (values.astype(kind) == values).all():
                return values.astype(kind)
    return values


def permuted_moments(df: DataFrame, n: int, seed: int, key: Sequence[str], outcome: str, columns: Sequence[str],
                     replicate: str = "b") -> DataFrame:
    """Moments of ``resample.permuted_outcome`` by replicate, as ``linmod.weighted_moments`` has them.

    Outcomes are held by place, ``OUTCOMES`` at a time: each such part is a pass over
    the rows, which takes the outcomes that the permutation finds in it.
    """
    spark = df.sparkSession
    names = [outcome, *columns]
    numbered = materialize(number_rows(df, [], list(key), "_position").select(
        (F.col("_position") - 1).cast("long").alias("_at"), *[F.col(c).cast("double").alias(c) for c in names]), "permutation-rows")
    size, width = numbered.count(), len(columns) + 1
    pairs = list(itertools.combinations_with_replacement(range(width), 2))
    rows = _dealt(numbered.dropna(subset=list(columns)).select("_at", F.array(F.lit(1.0), *columns).alias("_x")), "permutation-columns", "_at", _PERMUTED_PER_TASK)
    keys = [[int(w) for i in range(-(-draws.ROUNDS // draws.DRAWS_PER_DIGEST))
             for w in draws.digest_words(seed, [b * 2 + i], np.zeros((1, 0), np.uint8))[0, :, 0]] for b in range(n)]
    fields = ["n", f"s_{outcome}", f"s_{outcome}|{outcome}", *[f"s_{c}" for c in columns], *[f"s_{outcome}|{c}" for c in columns],
              *[f"s_{columns[i - 1]}|{columns[j - 1]}" for i, j in pairs if i]]
    schema = T.StructType([T.StructField("_b", T.IntegerType()), *[T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(fields))]])
    products = [(i, j) for i, j in pairs if i]

    def one_part(low: int, high: int) -> DataFrame:
        table = numbered.where((F.col("_at") >= low) & (F.col("_at") < high)).select("_at", outcome).toArrow()
        found = np.full(high - low, np.nan)
        found[table["_at"].to_numpy() - low] = table[outcome].to_numpy()  # NULL is NaN: neither takes part
        whole_part, known_all = high - low == size, not np.isnan(found).any()
        held = spark.sparkContext.broadcast(_smallest(found))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            outcomes, total = held.value, np.zeros((n, len(fields)))
            for chunk in _chunks(batches, _PERMUTED_PER_TASK):
                places, x = draws.Places(chunk["_at"].to_numpy(), size), _matrix(chunk["_x"], width)
                fixed = np.column_stack([x, *[x[:, i] * x[:, j] for i, j in products]])
                parts = [slice(first, first + _PERMUTED_AT_ONCE) for first in range(0, len(x), _PERMUTED_AT_ONCE)]
                parts = [(part, np.ascontiguousarray(x[part].T), fixed[part].sum(axis=0)) for part in parts]
                for b in range(n):
                    tables = places.tables(keys[b])
                    for part, columns_of, known in parts:
                        at = places.sent(tables, part)
                        if whole_part:
                            y = outcomes.take(at).astype(float, copy=False)
                        else:
                            at = np.where((at >= low) & (at < high), at - low, -1)
                            y = np.where(at < 0, np.nan, outcomes[at])
                        xs = columns_of
                        if not (whole_part and known_all):
                            ok = ~np.isnan(y)
                            if not ok.all():
                                y, xs, known = y[ok], columns_of[:, ok], fixed[part][ok].sum(axis=0)
                        crossed = xs @ y
                        total[b] += np.concatenate([known[:1], crossed[:1], [y @ y], known[1:width], crossed[1:], known[width:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(len(fields))]], names=schema.names)

        out = materialize(rows.mapInArrow(sums, schema).groupBy("_b").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(fields))]), "permutation-sums")
        held.destroy()
        return out

    parts = [one_part(low, min(low + OUTCOMES, size)) for low in range(0, size, OUTCOMES)]
    added = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        added = added.unionByName(part)
    if len(parts) > 1:
        added = added.groupBy("_b").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(fields))])
    return linmod.moments_of_sums(added.select(F.col("_b").alias(replicate), *[F.col(f"_s{i}").alias(c) for i, c in enumerate(fields)]), [replicate], names)


def _logistic_rounds(rows: DataFrame, width: int, p: int, seed: int | None, label: np.ndarray, size: np.ndarray, outcome: np.ndarray | None,
                     rounds: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, last steps and standard errors of logistic fits in lock-step: one pass over the rows a round.

    ``rows`` have ``_x``, ``width`` numbers of which the first ``p`` are the regressors.  With a ``seed`` the
    outcome is the next one, and rows weigh as it draws for ``_key`` in the replicates ``label``.  Without, they
    weigh one each, and ``outcome`` has the sums of outcome times regressor.
    """
    pairs = list(itertools.combinations_with_replacement(range(p), 2))
    coefficients, running = np.zeros((len(label), p)), np.arange(len(label))
    step, errors = np.full(len(label), np.inf), np.full((len(label), p), np.nan)
    schema = T.StructType([T.StructField("_r", T.IntegerType()), *[T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(pairs) + p)]])
    for _ in range(rounds):
        if not len(running):
            break
        now, drawn = np.ascontiguousarray(coefficients[running].T), label[running]

        def sums(batches: Iterator[pa.RecordBatch], now=now, drawn=drawn) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(pairs) + p, len(drawn)))
            wanted = np.unique(drawn // draws.DRAWS_PER_DIGEST)
            place = np.searchsorted(wanted, drawn // draws.DRAWS_PER_DIGEST) * draws.DRAWS_PER_DIGEST + drawn % draws.DRAWS_PER_DIGEST
            for chunk in _chunks(batches, ROWS_PER_TASK // 2):
                x = _matrix(chunk["_x"], width)[:, :p + (seed is not None)]
                weights = None
                if seed is not None:
                    x, y = x[:, :p], x[:, p:]
                    weights = np.empty((len(drawn), len(x)), np.uint8)
                    for some, w in _key_draws(chunk["_key"], seed, wanted):
                        inside = np.flatnonzero((place >= some.start) & (place < some.stop))
                        weights[inside] = w[place[inside] - some.start]
                squares = np.column_stack([x[:, i] * x[:, j] for i, j in pairs])
                for low in range(0, len(x), _ROWS_AT_ONCE):
                    part = slice(low, low + _ROWS_AT_ONCE)
                    with np.errstate(over="ignore"):
                        mu = 1 / (1 + np.exp(-(x[part] @ now)))
                    curve = mu * (1 - mu)
                    left = mu  # of the outcome, where it is the same in every replicate
                    if weights is not None:
                        w = weights[:, part].T
                        curve *= w
                        left = w * (y[part] - mu)
                    total[:len(pairs)] += squares[part].T @ curve
                    total[len(pairs):] += x[part].T @ left
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(drawn), dtype=np.int32)), *[pa.array(t) for t in total]], names=schema.names)

        added = rows.mapInArrow(sums, schema).groupBy("_r").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(pairs) + p)])
        got = np.array([list(r) for r in added.collect()], dtype=float)  # one row per replicate
        got = got[np.argsort(got[:, 0]), 1:]
        info = np.empty((len(running), p, p))
        for at, (i, j) in enumerate(pairs):
            info[:, i, j] = info[:, j, i] = got[:, at]
        gradient = got[:, len(pairs):] if outcome is None else outcome[running] - got[:, len(pairs):]
        for r, b in enumerate(running):
            try:
                inverse = np.linalg.inv(info[r])
            except np.linalg.LinAlgError:
                step[b], coefficients[b], errors[b] = np.nan, np.nan, np.nan
                continue
            moved = inverse @ gradient[r]
            # separated classes leave nothing but the rounding of the sums
            sums_of = size[b] if outcome is None else np.abs(outcome[b]) + np.abs(got[r, len(pairs):])
            if not (np.abs(inverse) @ np.broadcast_to(np.finfo(float).eps * sums_of, p)).max() < 1e-4:
                moved = np.full(p, np.nan)
            coefficients[b] += moved
            with np.errstate(invalid="ignore"):
                step[b], errors[b] = np.abs(moved).max(), np.sqrt(np.diag(inverse))
        running = running[(step[running] > tol) & (step[running] < 1e3)]
    return coefficients, step, errors


# ---- fits near one fit -----------------------------------------------------------

class _Expansion:
    """Sums from which the score of logistic fits near the coefficients ``beta`` follows, as a power series.

    Regressors are brought to -1 .. 1 (less ``middle``, by ``half``), so a row's linear predictor moves by at most the sum
    d of the absolute changes of the coefficients of these.  The score of all rows is then a polynomial in the changes
    whose coefficients are sums over the rows; what is left out is at most ``rest`` * d^(``order`` + 1) a row.
    """

    def __init__(self, beta: np.ndarray, middle: np.ndarray, half: np.ndarray, order: int):
        self.p, self.beta, self.middle, self.half, self.order = len(beta), beta, middle, half, order
        self.back = np.diag(1 / half)  # changes of these regressors' coefficients to those of the given ones
        self.back[0, 1:] = -middle[1:] / half[1:]
        self.powers = [list(itertools.combinations_with_replacement(range(self.p), k)) for k in range(order + 2)]
        self.place = {m: i for some in self.powers[1:] for i, m in enumerate(some)}
        self.starts = np.cumsum([1 + self.p, *[len(m) for m in self.powers[1:]]])
        self.width = int(self.starts[-1])
        self.rest = self.largest(order + 1)

    @staticmethod
    def coefficients(eta: np.ndarray, order: int) -> list[np.ndarray]:
        """Of the power series of the logistic function about ``eta``."""
        with np.errstate(over="ignore"):
            out = [1 / (1 + np.exp(-eta))]
        for k in range(order):
            out.append((out[k] - sum(out[i] * out[k - i] for i in range(k + 1))) / (k + 1))
        return out

    @staticmethod
    def largest(order: int) -> float:
        """The largest such coefficient anywhere."""
        return 1.01 * float(np.abs(_Expansion.coefficients(np.linspace(-40, 40, 80_001), order)[order]).max())

    def terms(self, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        """1, the scaled regressors times the outcome, and the terms of the score, of each row."""
        z = ((x - self.middle) / self.half).T
        z[0] = 1
        series = self.coefficients(x @ self.beta, self.order)
        out = np.empty((self.width, len(x)))
        out[0] = 1
        out[1:1 + self.p] = 0 if y is None else z * y
        known = {(): np.ones(len(x))}
        for k in range(self.order + 1):
            known = {m: known[m[:-1]] * z[m[-1]] if m[-1] else known[m[:-1]] for m in self.powers[k + 1]}
            for i, m in enumerate(self.powers[k + 1]):
                np.multiply(known[m], series[k], out=out[self.starts[k] + i])
        return out.T

    def _moment(self, sums: np.ndarray, power: tuple[int, ...]) -> np.ndarray:
        return sums[:, self.starts[len(power) - 1] + self.place[tuple(sorted(power))]]

    def score(self, sums: np.ndarray, target: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score and the information of all fits at the changes ``moved``."""
        score, info = target.copy(), np.zeros((len(moved), self.p, self.p))
        for k in range(self.order + 1):
            for m in self.powers[k]:
                ways = math.factorial(k) / math.prod(math.factorial(m.count(i)) for i in set(m))
                by = ways * moved[:, list(m)].prod(axis=1)
                for j in range(self.p):
                    score[:, j] -= by * self._moment(sums, (*m, j))
                    if k < self.order:
                        for other in range(j, self.p):
                            info[:, j, other] += (k + 1) * by * self._moment(sums, (*m, j, other))
        lower = np.tril_indices(self.p, -1)
        info[:, lower[0], lower[1]] = info[:, lower[1], lower[0]]
        return score, info

    def fits(self, sums: np.ndarray, target: np.ndarray, size: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients, a bound of their error and standard errors; the bound is NaN where ``tol`` is not sure to be kept."""
        moved, step, inverse = np.zeros_like(target), np.full(len(target), np.inf), None
        with np.errstate(all="ignore"):
            for _ in range(20):
                score, info = self.score(sums, target, moved)
                try:
                    inverse = np.linalg.inv(np.where(np.isfinite(info), info, np.eye(self.p)))
                except np.linalg.LinAlgError:
                    return moved, np.full(len(target), np.nan), moved
                change = np.einsum("rij,rj->ri", inverse, score)
                moved, step = moved + change, np.abs(change @ self.back.T).max(axis=1)
                if not (step > tol / 100).any():
                    break
            away = np.abs(moved).sum(axis=1)
            reach = np.abs(inverse).sum(axis=2) * size[:, None]
            left = self.rest * away ** (self.order + 1) + 8 * np.finfo(float).eps
            bound = (reach * left[:, None]) @ np.abs(self.back).T
            bent = reach.max(axis=1) * (self.order + 1) * self.rest * away ** self.order  # of the information, relatively
            kept = (step <= tol / 100) & (bound.max(axis=1) <= tol / 10) & (bent <= 1e-7)
            errors = np.sqrt(np.einsum("ij,rjk,ik->ri", self.back, inverse, self.back))
        return self.beta + moved @ self.back.T, np.where(kept & np.isfinite(errors).all(axis=1), bound.max(axis=1), np.nan), errors


def _expansion(rows: DataFrame, width: int, p: int, size: float, outcome: np.ndarray, tol: float, most: int = 9, spread: float = 3.0) -> _Expansion | None:
    """About the fit to the sums ``outcome`` over the ``size`` rows; None if resampled fits would lie too far from it."""
    x = lambda i: F.element_at("_x", i + 1)
    ends = rows.agg(*[F.min(x(i)) for i in range(p)], *[F.max(x(i)) for i in range(p)]).first()
    if ends[0] is None:
        return None
    low, high = np.array(ends[:p], dtype=float), np.array(ends[p:], dtype=float)
    with np.errstate(all="ignore"):
        middle, half = (low + high) / 2, (high - low) / 2
    middle[0], half[0] = 0, 1
    if not (np.isfinite(middle).all() and np.isfinite(half).all() and (half > 0).all()):
        return None
    beta, step, errors = _logistic_rounds(rows, width, p, None, np.zeros(1, np.int64), np.array([size]), outcome[None], tol=tol)
    if not (step[0] <= tol and np.isfinite(errors[0]).all()):
        return None
    # the spread of the scaled coefficients, the constant being that at the middle of the regressors
    near = errors[0] * half
    near[0] = np.sqrt(errors[0, 0] ** 2 + (errors[0, 1:] * middle[1:]) ** 2 @ np.ones(p - 1))
    away, reach = spread * near.sum(), 4 * size * (near ** 2).sum()
    scale = np.abs(np.diag(1 / half)).max() + np.abs(middle[1:] / half[1:]).sum()
    for order in range(2, most + 1):
        found = _Expansion(beta[0], middle, half, order)
        if found.width > _TERMS:
            return None
        if reach * found.rest * away ** order * max(away * scale / (tol / 10), (order + 1) / 1e-7) <= 1:
            return found
    return None


def _logistic_terms(rows: DataFrame, xs: Sequence[str], replicate: str, label: np.ndarray, size: np.ndarray, coefficients: np.ndarray,
                    step: np.ndarray, errors: np.ndarray, tol: float) -> DataFrame:
    state = rows.sparkSession.createDataFrame(
        [(int(b), c.tolist(), float(s), e.tolist(), float(w)) for b, c, s, e, w in zip(label, coefficients, step, errors, size)],
        f"`{replicate}` int, _beta array<double>, _step double, _se array<double>, _n double")
    return linmod.logistic_terms(state, [replicate], [linmod.INTERCEPT, *xs], tol)


def bootstrap_logistic(df: DataFrame, n: int, seed: int, key: Sequence[str], y: str, xs: Sequence[str], replicate: str = "b",
                       tol: float = 1e-8) -> DataFrame:
    """``linmod.fit_logistic`` of every replicate of ``resample.bootstrap_rows``.

    With many rows all replicates lie near the fit to the rows themselves: one pass sums a power series about it for
    each of them.  Replicates for which that is not sure to be as good as ``tol`` take the rounds of the plain fit.
    """
    xs = list(xs)
    p, width = len(xs) + 1, len(xs) + 2
    used = df.dropna(subset=[y, *xs])
    rows = _dealt(used.select(draws.key_text(*[F.col(k) for k in key]).alias("_key"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]).alias("_x")),
                  "logistic-rows", "_key")
    x = lambda i: F.element_at("_x", i + 1)
    whole = rows.agg(F.count(F.lit(1)), *[F.sum(x(i) * x(p)) for i in range(p)]).first()
    about = _expansion(rows, width, p, float(whole[0]), np.array(whole[1:], dtype=float), tol) if whole[0] else None
    if about is None:
        found = _weighted_sums(rows, [], n, seed, 1, lambda chunk: np.ones((chunk.num_rows, 1))).collect()  # one row per replicate
        label, size = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float)
        return _logistic_terms(rows, xs, replicate, label, size, *_logistic_rounds(rows, width, p, seed, label, size, None, tol=tol), tol)

    def terms(chunk: pa.Table) -> np.ndarray:
        values = _matrix(chunk["_x"], width)
        return about.terms(values[:, :p], values[:, p])

    added = _weighted_sums(rows, [], n, seed, about.width, terms)
    found = np.array([list(r) for r in added.orderBy(*added.columns[:-min(about.width, _SUMS_IN_ROW)]).collect()], dtype=float)  # a few rows per replicate
    label = np.unique(found[:, 0]).astype(np.int64)
    sums = np.ascontiguousarray(found[:, -min(about.width, _SUMS_IN_ROW):]).reshape(len(label), -1)[:, :about.width]
    size = sums[:, 0]
    coefficients, step, errors = about.fits(sums, sums[:, 1:1 + p], size, tol)
    far = np.flatnonzero(np.isnan(step))
    if len(far):
        coefficients[far], step[far], errors[far] = _logistic_rounds(rows, width, p, seed, label[far], size[far], None, tol=tol)
    return _logistic_terms(rows, xs, replicate, label, size, coefficients, step, errors, tol)


def permuted_logistic(df: DataFrame, n: int, seed: int, key: Sequence[str], y: str, xs: Sequence[str], replicate: str = "b",
                      tol: float = 1e-8) -> DataFrame:
    """``linmod.fit_logistic`` of every replicate of ``resample.permuted_outcome``, without rows that lack an outcome or a regressor.

    Replicates differ in their sums of outcome times regressor only, so they share one power series about the fit to the mean of these.
    """
    xs = list(xs)
    p = len(xs) + 1
    used = materialize(df.dropna(subset=[y, *xs]).select(*dict.fromkeys([*key, y, *xs])), "logistic-rows")
    stats = permuted_moments(used, n, seed, key, y, xs, replicate)
    total = lambda c: F.col("n") * c
    scores = stats.select(replicate, "n", F.array(total(F.col(f"m_{y}")), *[total(F.col(f"c_{y}|{c}") + F.col(f"m_{y}") * F.col(f"m_{c}")) for c in xs]))
    dealt = used.select(F.monotonically_increasing_id().alias("_at"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in xs]).alias("_x"))
    rows = _dealt(dealt, "logistic-columns", "_at")
    found = scores.collect()  # one row per replicate
    label, size = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float)
    outcome = np.array([r[2] for r in found], dtype=float).reshape(-1, p)
    about = _expansion(rows, p, p, size[0], outcome.mean(axis=0), tol) if len(size) and (size == size[0]).all() else None
    if about is None:
        return _logistic_terms(rows, xs, replicate, label, size, *_logistic_rounds(rows, p, p, None, label, size, outcome, tol=tol), tol)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros(about.width)
        for chunk in _chunks(batches, _ROWS_IN_PRODUCT):
            added += about.terms(_matrix(chunk["_x"], p), None).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(about.width, dtype=np.int32)), pa.array(added)], names=["_i", "_s"])

    added = rows.mapInArrow(sums, "_i int, _s double").groupBy("_i").agg(F.sum("_s").alias("_s")).orderBy("_i").collect()  # one row per sum
    shared = np.array([r[1] for r in added], dtype=float)[None]
    target = np.column_stack([outcome[:, 0], (outcome[:, 1:] - outcome[:, :1] * about.middle[1:]) / about.half[1:]])
    coefficients, step, errors = about.fits(shared, target, size, tol)
    far = np.flatnonzero(np.isnan(step))
    if len(far):
        coefficients[far], step[far], errors[far] = _logistic_rounds(rows, p, p, None, label[far], size[far], outcome[far], tol=tol)
    return _logistic_terms(rows, xs, replicate, label, size, coefficients, step, errors, tol)


# ---- equal-frequency bins of all replicates --------------------------------------

def _value_codes(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the values among the distinct ones, in Spark's order (NaN last, both zeros equal)."""
    kind = column.type
    if pa.types.is_floating(kind) or pa.types.is_integer(kind):
        values = column.to_numpy()
    else:
        values = np.empty(len(column), object)
        values[:] = column.to_pylist()
    return np.unique(values, return_inverse=True)[1]


def _weighed(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``rows`` with ``_w`` instead of the key text ``_k``: the weights of all replicates, two in a byte.

    The rows of a key lie side by side, so its weights are drawn once.
    """
    blocks = np.arange(-(-n // draws.DRAWS_PER_DIGEST))
    kept = [c for c in rows.columns if c != "_k"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("_w", T.BinaryType())])
    width = len(blocks) * draws.DRAWS_PER_DIGEST // 2

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 4 * ROWS_PER_TASK):
            coded = chunk["_k"].combine_chunks().dictionary_encode()
            packed = np.empty((len(coded.dictionary), width), np.uint8)
            for first in range(0, len(packed), _KEYS_AT_ONCE):
                part = coded.dictionary.slice(first, _KEYS_AT_ONCE)
                for some, weights in _key_draws(pa.chunked_array([part]), seed, blocks):
                    packed[first:first + len(part), some.start // 2:some.stop // 2] = (weights[::2] | weights[1::2] << 4).T
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(packed), [None, pa.py_buffer(packed)])
            taken = held.cast(pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*[chunk[c].combine_chunks() for c in kept], taken], names=schema.names)

    return rows.repartition("_k").sortWithinPartitions("_k").mapInArrow(draw, schema)


def _packed(column: pa.ChunkedArray) -> np.ndarray:
    """``_w`` as a matrix (rows, bytes)."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(chunk), -1))
    return np.concatenate(parts)


def _bin_sums(rows: pa.Table, n: int, bins: int, before: np.ndarray | None = None, total: np.ndarray | None = None) -> Iterator[tuple]:
    """Replicates, bins and class counts of the rows (``_v``, ``_y``, ``_w``) of a group or of a slice of one.

    ``before`` has the weight below the slice and ``total`` that of the group, by replicate.  A
    value with the weight w below it is in one of the first j bins if w * bins < j * total.
    Sums of stretches of rows find the stretch in which a bin ends, and only that is looked into.
    """
    code = _value_codes(rows["_v"])
    order = np.argsort(code, kind="stable")
    code = code[order]
    ends = np.append(np.flatnonzero(code[1:] != code[:-1]), len(code) - 1)  # the last row of each value
    stretches = -(-len(code) // _STRETCH)
    y = rows["_y"].to_numpy()
    y = y.astype(np.uint8 if y.min() >= 0 and y.max() <= 1 else np.int64)[order]
    y = np.pad(y, (0, stretches * _STRETCH - len(y))).reshape(stretches, _STRETCH)
    packed = _packed(rows["_w"])[order]
    inside = np.arange(_STRETCH)
    step = max(1, _WEIGHTS_HELD // len(code))
    for first in range(0, (n + 1) // 2, step):
        some = np.ascontiguousarray(packed[:, first:first + step].T)
        w = np.zeros((2 * len(some), stretches * _STRETCH), np.uint8)
        w[::2, :len(code)], w[1::2, :len(code)] = some & 15, some >> 4
        w = w.reshape(len(w), stretches, _STRETCH)[:n - 2 * first]
        drawn = slice(2 * first, 2 * first + len(w))
        sums, pos = (np.zeros((len(w), stretches + 1), np.int64) for _ in range(2))
        for out, part in ((sums, w), (pos, w * y)):
            np.cumsum(part.sum(axis=2, dtype=np.int64), axis=1, out=out[:, 1:])
        whole = sums[:, -1] if total is None else total[drawn]
        low = np.zeros(len(w), np.int64) if before is None else before[drawn]
        limits = np.arange(1, bins + 1) * whole[:, None]
        need = -(-limits // bins) - low[:, None]  # the first row with so much weight up to it ends the bin
        b = np.arange(len(w))[:, None]
        at = np.array([np.searchsorted(own[1:], wanted) for own, wanted in zip(sums, need)]).clip(0, stretches - 1)
        upto = np.cumsum(w[b, at], axis=2, dtype=np.int64) + sums[b, at][:, :, None]
        row = np.minimum(at * _STRETCH + (upto < need[:, :, None]).sum(axis=2), len(code) - 1)
        row = ends[code[row]]
        at, in_bin = row // _STRETCH, inside <= (row % _STRETCH)[:, :, None]
        last = w[b, at] * in_bin
        reached = limits > low[:, None] * bins
        sums = np.where(reached, sums[b, at] + last.sum(axis=2, dtype=np.int64), 0)
        pos = np.where(reached, pos[b, at] + (last * y[at]).sum(axis=2, dtype=np.int64), 0)
        sums, pos = np.diff(sums, prepend=0, axis=1), np.diff(pos, prepend=0, axis=1)
        found, j = np.nonzero(sums)
        yield found + 2 * first, j + 1, pos[found, j], sums[found, j] - pos[found, j]


def bootstrap_bins(df: DataFrame, n: int, seed: int, key: str, by: str, value: str, y: str, bins: int,
                   replicate: str = "b") -> DataFrame:
    """``by``, ``replicate``, ``bin`` and class counts ``pos``, ``neg`` in equal-frequency bins cut anew in each Poisson bootstrap.

    The weights are those of ``resample.bootstrap_rows``.  A task holds one group, sorted once for
    all replicates.  A group of more rows than a task may sort is cut into slices of values: their
    sums by replicate come first, so each slice knows the weight below it.
    """
    source = df.where(F.col(value).isNotNull() & F.col(y).isNotNull()).select(
        F.col(by).alias("_f"), F.col(value).alias("_v"), draws.key_text(F.col(key)).alias("_k"), F.col(y).cast("long").alias("_y"))
    rows = materialize(source, "resample-rows")
    spread = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_slice(rows)))
    schema = T.StructType([rows.schema["_f"], T.StructField("_b", T.IntegerType()), T.StructField("bin", T.IntegerType()),
                           T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])

    def table_of(part: pa.Table, found: Iterator[tuple]) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*found)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        group = pa.array([part["_f"][0].as_py()] * len(columns[0]), part.schema.field("_f").type)
        return pa.Table.from_arrays([group, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=schema.names)

    def whole(part: pa.Table) -> pa.Table:
        return table_of(part, _bin_sums(part, n, bins))

    def one_slice(part: pa.Table, below: pa.Table) -> pa.Table:
        below = below.sort_by("_b")
        return table_of(part, _bin_sums(part, n, bins, below["_before"].to_numpy(), below["_total"].to_numpy()))

    sliced = value_slices(rows, ["_f"], "_v", "_k")
    if sliced is None:
        counts = _weighed(rows, n, seed).repartition(spread, "_f").groupBy("_f").applyInArrow(whole, schema)
    else:
        drawn = materialize(_weighed(sliced, n, seed), "resample-weights")
        small, large = drawn.where(F.col(SLICE).isNull()).drop(SLICE), drawn.where(F.col(SLICE).isNotNull())
        below = materialize(_slice_sums(large, n), "slice-sums")
        # the slice of one value is in one bin, however many rows it has
        alone = below.where((F.col(SLICE) % 2 == 1) & (F.col("pos") + F.col("neg") > 0)).select(
            "_f", "_b", (F.floor(F.col("_before") * bins / F.col("_total")) + 1).cast("int").alias("bin"), "pos", "neg")
        between = large.where(F.col(SLICE) % 2 == 0).repartition(spread, "_f", SLICE).groupBy("_f", SLICE).cogroup(
            below.where(F.col(SLICE) % 2 == 0).select("_f", SLICE, "_b", "_before", "_total").groupBy("_f", SLICE))
        counts = small.repartition(spread, "_f").groupBy("_f").applyInArrow(whole, schema).unionByName(alone).unionByName(
            between.applyInArrow(one_slice, schema)).groupBy("_f", "_b", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return counts.select(F.col("_f").alias(by), F.col("_b").alias(replicate), "bin", "pos", "neg")


def _slice_sums(rows: DataFrame, n: int) -> DataFrame:
    """``_f``, slice, replicate ``_b``, class counts, the weight ``_before`` the slice and the group's ``_total``."""
    schema = T.StructType([rows.schema["_f"], T.StructField(SLICE, T.IntegerType()), T.StructField("_b", T.IntegerType()),
                           T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])
    most = max(1, _HELD // (2 * n))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kind = None

        def emit() -> Iterator[pa.RecordBatch]:
            for (group, at), total in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([group] * n, kind), pa.array([at] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(total[0]), pa.array(total[1])], names=schema.names)
            held.clear()

        for chunk in _chunks(batches, ROWS_PER_TASK):
            kind = chunk.schema.field("_f").type
            known: dict[tuple, int] = {}
            code = np.array([known.setdefault(g, len(known)) for g in zip(chunk["_f"].to_pylist(), chunk[SLICE].to_pylist())])
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(known)))
            packed, y = _packed(chunk["_w"])[order], chunk["_y"].to_numpy()[order][:, None]
            found = np.empty((len(known), 2, 2 * packed.shape[1]), np.int64)
            for half, w in enumerate((packed & 15, packed >> 4)):
                found[:, 0, half::2] = np.add.reduceat(w * y, starts, axis=0)
                found[:, 1, half::2] = np.add.reduceat(w * (1 - y), starts, axis=0)
            for label, total in zip(known, found[:, :, :n]):
                if label in held:
                    held[label] += total
                else:
                    held[label] = total
            if len(held) >= most:
                yield from emit()
        yield from emit()

    added = rows.mapInArrow(sums, schema).groupBy("_f", SLICE, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    group, w = W.partitionBy("_f", "_b"), F.col("pos") + F.col("neg")
    before = group.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    return added.withColumns({"_before": F.coalesce(F.sum(w).over(before), F.lit(0)), "_total": F.sum(w).over(group)})
