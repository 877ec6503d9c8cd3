from fractions import Fraction
import math

import numpy as np
import pytest

from cohortloom.llm import feast, whitening

TYPE = "vec_id long, embedding array<double>, x int, whitened string"


def _plain(vectors):
    """Deviations, eigenvalues and whitened values by whole numbers and NumPy."""
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(d)]
    gaps = [[n * row[i] - sums[i] for i in range(d)] for row in x]
    cov = np.array([[float(Fraction(sum(g[i] * g[j] for g in gaps), n**3)) for j in range(d)] for i in range(d)])
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1], turn[:, ::-1]
    centred = np.array([[float(Fraction(g, n)) for g in row] for row in gaps])
    return [sum(g * g for g in row) for row in gaps], values, values / np.trace(cov), centred @ turn


def _matrix(values, seed=0):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    out = (turn * values) @ turn.T
    return (out + out.T) / 2


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).exponential(1, 40), np.ones(20), np.array([9.0] * 3 + [1.0] * 10 + [0.0] * 12),
    1 + 1e-9 * np.arange(25), 0.1 ** np.arange(14), np.array([2.0]), np.linspace(5, 1, 64), np.array([1e-30, 1e-31]), np.array([1e20, 3e19, 0.0])])
def test_intervals_hold_every_pair(values):
    matrix, wanted = _matrix(values), 12
    cuts = feast.intervals(matrix, wanted, whitening.FLOOR)
    true = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    found = [feast.pairs(matrix, *cut) for cut in cuts]
    assert all(len(v) == count for (v, _), (_, _, count) in zip(found, cuts))
    got, vectors = feast.joined(matrix, np.concatenate([v for _, v in found], axis=1))
    known = int((true > whitening.FLOOR * true[0] * 1.5).sum())
    assert len(got) >= min(wanted, known)
    assert np.allclose(got, true[: len(got)], rtol=0, atol=1e-13 * true[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_inertia_counts_indefinite_matrices():
    for seed in range(20):
        values = np.random.default_rng(seed).integers(-3, 4, 15).astype(float)
        matrix = _matrix(values, seed)
        assert feast.above(matrix, 0.5) == (values > 0.5).sum()
    assert feast.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1
    assert feast.above(np.zeros((3, 3)), 0) == 0


def _check(spark, rows, vectors, parts):
    got = whitening.whiten(spark.createDataFrame(rows, TYPE).repartition(parts)).collect()
    deviations, values, explained, projected = _plain([v for _, v in vectors])
    k = min(32, int((values > 1e-10 * values[0]).sum()))
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted((i or -1, c + 1) for i, _ in vectors for c in range(k))
    by_place = {(i, c): (deviations[at], projected[at, c]) for at, (i, _) in enumerate(vectors) for c in range(k)}
    sign = {}
    for r in got:
        deviation, value = by_place[r.vec_id, r.component - 1]
        assert r.n == len(vectors) and r.identity_error < 1e-4
        assert r.deviation == (deviation if deviation < 1 << 63 else None)
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-8)
        value /= math.sqrt(values[r.component - 1])
        if abs(value) > 1e-3:
            assert sign.setdefault(r.component, value * r.whitened > 0) == (value * r.whitened > 0)
        assert math.isclose(abs(r.whitened), abs(value), rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_matches_whole_numbers(spark, scale):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in scale * rng.standard_normal(40) * np.linspace(3, 1, 40)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 39 + [None]), (103, [float("nan")] * 40), (104, [float("inf")] + [0.0] * 39),
           (105, [1.0, 2.0]), (106, [1e300] * 40)]
    vectors.append((None, [0.25 * scale] * 40))
    _check(spark, [(i, v, 1, "w") for i, v in vectors + odd], vectors, 3)


def test_few_rows_and_equal_rows(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, TYPE)).collect()

    assert run([]) == []
    assert run([(1, None, None, None)]) == []
    assert run([(1, [1.0, 2.0], 1, "w")]) == []
    assert run([(1, [1.0, 2.0], 1, "w"), (1, [1.0, 2.0], 1, "w")]) == []
    two = run([(1, [1.0, 2.0], 1, "w"), (1, [3.0, 2.0], 1, "w"), (2, [1.0, 2.0], 1, "w")])
    assert len(two) == 3 and {r.component for r in two} == {1} and all(math.isclose(r.explained, 1) for r in two)
    assert sorted(abs(round(r.whitened, 9)) for r in two) == [round(0.5**0.5, 9)] * 2 + [round(2**0.5, 9)]


def test_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(8)], 0, "") for i in range(200)]
    both = [{(r.vec_id, r.component): (r.deviation, round(r.whitened, 12), r.explained)
             for r in whitening.whiten(spark.createDataFrame(rows, TYPE).repartition(p), components=5).collect()} for p in (1, 7)]
    assert both[0] == both[1] and len(both[0]) == 1000
