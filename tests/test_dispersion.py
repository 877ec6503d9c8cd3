"""Negative-binomial dispersions by adjusted likelihood, against plain numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import normalize


def plain_likelihood(x, counts, mus, cells):
    r = math.exp(-x)
    own = sum(math.lgamma(k + r) - math.lgamma(r) - k * math.log(m + r) - r * math.log1p(m / r) for k, m in zip(counts, mus))
    weights = {}
    for m, c in zip(mus, cells):
        weights[c] = weights.get(c, 0.0) + m * r / (m + r)
    return own - sum(math.log(w) for w in weights.values()) / 2


def table(seed, n=24):
    """(sample, feature, value), size factors and groups; sparse, with small counts and features without scatter."""
    rng = np.random.default_rng(seed)
    factors = np.exp(rng.normal(0, 0.3, n))
    rows = []
    for f, (mean, a) in enumerate([(50, 0.3), (3, 1.0), (400, 0.05), (1, 3.0), (20, 0.0), (0.3, 0.5), (80, 2.0)]):
        for j in range(n):
            rate = mean * factors[j] * (2 if j % 2 else 1)
            if a:
                rate *= rng.gamma(1 / a, a)
            k = int(rng.poisson(rate))
            if k:
                rows.append((j, f"f{f}", k))
    return rows, [(j, float(factors[j])) for j in range(n)]


@pytest.mark.parametrize("grouped", [False, True])
def test_fit_beats_a_fine_grid(spark, grouped):
    rows, factors = table(3)
    counts = spark.createDataFrame(rows, "sample int, feature string, value int").repartition(3)
    sized = spark.createDataFrame(factors, "sample int, size_factor double")
    groups = spark.createDataFrame([(j, j % 2) for j, _ in factors], "sample int, group int") if grouped else None
    expected = normalize.expected_counts(counts, sized, "sample", "feature", "value", groups)
    fits = {r.feature: r for r in normalize.likelihood_dispersions(expected, "feature", len(factors)).collect()}
    held = {}
    for r in expected.collect():
        held.setdefault(r.feature, []).append((r._k, r._mu, r._cell))
    assert set(fits) == set(held) == {f"f{i}" for i in range(7)}
    low, high = math.log(1e-8), math.log(len(factors))
    for f, own in held.items():
        assert len(own) == len(factors)
        score = lambda x: plain_likelihood(x, *zip(*own))
        grid = np.linspace(low, high, 4000)
        best = max(map(score, grid))
        assert fits[f].converged
        # lgamma of numbers near 1e8 is only known to about 1e-6
        assert score(math.log(fits[f].dispersion)) >= best - 1e-5, f
    # without the groups, their difference is scatter
    assert (fits["f4"].dispersion < 0.05) == grouped and 0.1 < fits["f0"].dispersion < 1.5


def test_likelihood_columns_equal_plain_numbers(spark):
    rows, factors = table(5)
    counts = spark.createDataFrame(rows, "sample int, feature string, value int")
    expected = normalize.expected_counts(counts, spark.createDataFrame(factors, "sample int, size_factor double"), "sample", "feature", "value")
    at = spark.createDataFrame([(f"f{i}", x) for i in range(7) for x in (-12.0, -3.0, 0.0, 2.5)], "feature string, log_dispersion double")
    held = {}
    for r in expected.collect():
        held.setdefault(r.feature, []).append((r._k, r._mu, r._cell))
    found = normalize.dispersion_likelihood(expected, at, "feature", ["log_dispersion"]).collect()
    assert len(found) == 28
    for r in found:
        assert math.isclose(r.log_likelihood, plain_likelihood(r.log_dispersion, *zip(*held[r.feature])), rel_tol=1e-8, abs_tol=1e-6)
    slopes = normalize._likelihood_slopes(expected, at.where("log_dispersion = -3.0"), "feature").collect()
    for r in slopes:
        score = lambda x: plain_likelihood(x, *zip(*held[r.feature]))
        assert math.isclose(r._slope, (score(-2.999) - score(-3.001)) / 0.002, rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(r._bend, (score(-2.99) - 2 * score(-3.0) + score(-3.01)) / 1e-4, rel_tol=1e-2, abs_tol=1e-2)


def test_stabilised_counts_tell_whether_the_trend_settled(spark):
    rng = np.random.default_rng(2)
    rows = [(j, f"g{f}", int(rng.poisson(rng.gamma(5, (f + 1) * 4)))) for f in range(30) for j in range(20)]
    counts = spark.createDataFrame(rows, "sample int, feature string, value int")
    for method in ("likelihood", "moments"):
        out = normalize.variance_stabilize(counts, "sample", "feature", "value", method=method)
        first = out.agg(F.count(F.lit(1)).alias("n"), F.min("trend_converged").alias("ok"), F.min("value").alias("low")).first()
        assert first.n == 600 and first.ok and first.low > 0
    with pytest.raises(ValueError):
        normalize.variance_stabilize(counts, "sample", "feature", "value", method="other")


def _reads(spark, query):
    """The rows of a query, and how often it made those of the count matrix."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows, _ = table(5)
    source = spark.createDataFrame(rows, "sample int, feature string, value int").repartition(3).mapInArrow(count, "sample int, feature string, value int")
    return query(source).collect(), made.value / len(rows)


def test_the_count_matrix_is_made_once(spark, monkeypatch):
    """What makes the counts is a join of the largest tables; passes over them must not repeat it."""
    from cohortloom.plans import markers
    from study import catalog_stats

    people = spark.createDataFrame([(j, j % 2, j % 3, j / 7) for j in range(24)], "sample int, y int, batch int, age double")
    found, times = _reads(spark, lambda d: markers.prepare_matrix(d, "sample", "feature", "value", people, "batch", ["age"], "counts")[0])
    assert found and times == 1

    def optimum(source):
        monkeypatch.setattr(catalog_stats, "counts", lambda spark, folder: source)
        return catalog_stats.dispersion_optimum(spark, "")

    found, times = _reads(spark, optimum)
    assert found and times == 1
