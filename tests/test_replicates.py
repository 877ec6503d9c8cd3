"""Sums and fits of all replicates against the row-by-row resamples."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import draws
from cohortloom.operators import linmod, replicates, resample


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=70)
    rows = pd.DataFrame({"id": [*range(60), *range(55, 65)], "g": [f"g{i % 3}" for i in range(70)], "x": x, "z": rng.normal(size=70),
                         "y": x + rng.normal(size=70), "c": (x + 2 * rng.normal(size=70) > 0).astype(int)})
    return spark.createDataFrame(rows).withColumn("id", F.when(F.col("id") != 7, F.col("id"))).repartition(3)


def _near(a, b, keys, columns):
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) > 0
    assert a[keys].astype(str).equals(b[keys].astype(str))
    for c in columns:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-7, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("size", [1, 9, 60])
def test_digests(size):
    keys = np.frombuffer(bytes(range(65, 65 + 26)) * 5, np.uint8)[:2 * size].reshape(2, size)
    for blocks in ([0], [12, 99]):
        got = draws.digest_words(3, blocks, keys)
        for b, block in enumerate(blocks):
            for i in range(2):
                want = hashlib.md5(f"3|{block}".encode() + keys[i].tobytes()).digest()
                assert got[b, :, i].astype(">u4").tobytes() == want


@pytest.mark.parametrize("n", [1, 2, 7, 100, 977])
def test_permuted_places(spark, n):
    keys = spark.range(3).select(draws.round_keys(5, F.col("id").cast("int")).alias("k")).collect()
    for row in keys:
        at = draws.permuted_places(np.arange(n), row.k, n)
        want = spark.range(n).select(draws.permuted(F.col("id"), F.array(*map(F.lit, row.k)), n).alias("to")).toPandas()["to"]
        assert at.tolist() == want.tolist() and sorted(at) == list(range(n))


def test_bootstrap_moments_equal_the_rows(table):
    for by in ([], ["g"]):
        rows = resample.bootstrap_rows(table, 11, 3, ["id"])
        want = linmod.weighted_moments(rows, [*by, "b"], ["y", "x"], "w")
        got = replicates.bootstrap_moments(table, 11, 3, ["id"], ["y", "x"], by)
        assert got.columns == want.columns
        _near(got, want, [*by, "b"], [c for c in want.columns if c not in by])


def test_groups_are_handed_on_when_there_are_many(table, monkeypatch):
    want = linmod.weighted_moments(resample.bootstrap_rows(table, 6, 3, ["id"]), ["id", "b"], ["y"], "w")
    monkeypatch.setattr(replicates, "_HELD", 40)
    _near(replicates.bootstrap_moments(table, 6, 3, ["id"], ["y"], ["id"]), want, ["id", "b"], ["n", "m_y"])


def test_permuted_moments_equal_the_rows(table, monkeypatch):
    keyed = table.withColumn("k", F.monotonically_increasing_id()).withColumn("y", F.when(F.abs("z") < 2, F.col("y"))).localCheckpoint()
    rows = resample.permuted_outcome(keyed, 9, 2, ["k"], "y").withColumn("w", F.lit(1))
    want = linmod.weighted_moments(rows, ["b"], ["y", "x", "z"], "w")
    for part in (1_000_000, 13):
        monkeypatch.setattr(replicates, "OUTCOMES", part)
        got = replicates.permuted_moments(keyed, 9, 2, ["k"], "y", ["x", "z"])
        assert got.columns == want.columns
        _near(got, want, ["b"], want.columns[1:])


def test_logistic_fits_equal_the_rows(table):
    columns = ["n", "converged", "estimate", "std_error", "p_value", "odds_ratio"]
    want = linmod.fit_logistic(resample.bootstrap_rows(table, 10, 4, ["id"]), ["b"], "c", ["x", "z"], weight="w")
    _near(replicates.bootstrap_logistic(table, 10, 4, ["id"], "c", ["x", "z"]), want, ["b", "term"], columns)
    keyed = table.withColumn("k", F.monotonically_increasing_id()).localCheckpoint()
    want = linmod.fit_logistic(resample.permuted_outcome(keyed, 10, 4, ["k"], "c"), ["b"], "c", ["x", "z"])
    _near(replicates.permuted_logistic(keyed, 10, 4, ["k"], "c", ["x", "z"]), want, ["b", "term"], columns)


def test_fits_that_do_not_settle(spark):
    apart = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(12)], "id int, x double, y int")
    got = replicates.bootstrap_logistic(apart, 6, 1, ["id"], "y", ["x"])
    assert got.count() == 12 and got.where("converged or estimate is not null").count() == 0
    same = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(40)], "id int, x double, y int")
    got = replicates.permuted_logistic(same.where("x = 1"), 4, 1, ["id"], "y", ["x"])  # one class only
    assert got.count() == 8 and got.where("converged or estimate is not null").count() == 0
    few = replicates.permuted_logistic(apart.where("id between 5 and 7"), 8, 1, ["id"], "y", ["x"])  # separated in most
    assert few.count() == 16 and few.where("converged and abs(estimate) > 10").count() == 0
    nothing = apart.where("false")
    assert replicates.permuted_moments(nothing, 3, 1, ["id"], "y", ["x"]).count() == 0
    assert replicates.bootstrap_logistic(nothing, 3, 1, ["id"], "y", ["x"]).count() == 0


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(8)
    x, z = rng.uniform(-3, 5, 30_000), rng.integers(0, 2, 30_000)
    c = rng.random(30_000) < 1 / (1 + np.exp(0.4 - 0.3 * x + 0.5 * z))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(30_000), "x": x, "z": z, "c": c.astype(int)})).repartition(4).localCheckpoint()


@pytest.mark.parametrize("spread", [3.0, 0.3])
def test_logistic_fits_of_many_rows_take_one_pass(many, monkeypatch, spread):
    """Replicates near the fit to all rows come from a power series; what lies beyond its reach takes rounds of its own."""
    rounds, expansion, in_rounds = replicates._logistic_rounds, replicates._expansion, []

    def counted(rows, width, p, seed, label, *rest, **more):
        in_rounds.append(len(label))
        return rounds(rows, width, p, seed, label, *rest, **more)

    monkeypatch.setattr(replicates, "_logistic_rounds", counted)
    monkeypatch.setattr(replicates, "_expansion", lambda *a: expansion(*a, spread=spread))
    columns = ["n", "converged", "estimate", "std_error", "p_value", "odds_ratio"]
    want = linmod.fit_logistic(resample.bootstrap_rows(many, 8, 4, ["id"]), ["b"], "c", ["x", "z"], weight="w")
    _near(replicates.bootstrap_logistic(many, 8, 4, ["id"], "c", ["x", "z"]), want, ["b", "term"], columns)
    want = linmod.fit_logistic(resample.permuted_outcome(many, 8, 4, ["id"], "c"), ["b"], "c", ["x", "z"])
    _near(replicates.permuted_logistic(many, 8, 4, ["id"], "c", ["x", "z"]), want, ["b", "term"], columns)
    assert in_rounds == [1, 1] if spread == 3 else len(in_rounds) == 4


def test_power_series_and_its_bound():
    rng = np.random.default_rng(9)
    x = np.column_stack([np.ones(500), rng.uniform(2, 4, 500), rng.normal(size=500)])
    y, w = rng.integers(0, 2, 500).astype(float), rng.integers(0, 4, 500).astype(float)
    beta = np.array([0.3, -0.1, 0.2])
    low, high = x.min(axis=0), x.max(axis=0)
    middle, half = (low + high) / 2, (high - low) / 2
    middle[0], half[0] = 0, 1
    for order in (2, 5, 8):
        about = replicates._Expansion(beta, middle, half, order)
        sums = (w @ about.terms(x, y))[None]
        moved = np.array([[0.05, -0.08, 0.06]])
        score, info = about.score(sums, sums[:, 1:4], moved)
        at = beta + about.back @ moved[0]
        z = (x - middle) / half
        z[:, 0] = 1
        mu = 1 / (1 + np.exp(-(x @ at)))
        away = np.abs(moved).sum()
        assert np.abs(score[0] - z.T @ (w * (y - mu))).max() <= w.sum() * about.rest * away ** (order + 1) + 1e-10
        assert np.abs(info[0] - (z * (w * mu * (1 - mu))[:, None]).T @ z).max() <= w.sum() * (order + 1) * about.rest * away ** order + 1e-10


def test_places_in_parts():
    keys, n = [3_000_000_019, 5, 77_777, 4_294_967_295, 123_456_789, 0], 1_000_003
    whole = draws.permuted_places(np.arange(n), keys, n)
    assert (np.bincount(whole, minlength=n) == 1).all()
    some = draws.Places(np.arange(500_000, 500_100), n)
    tables = some.tables(keys)
    assert some.sent(tables).tolist() == whole[500_000:500_100].tolist()
    assert some.sent(tables, slice(40, 60)).tolist() == whole[500_040:500_060].tolist()


def test_no_row_for_each_replicate(table):
    """The sums of 2,000 replicates come from one pass that returns no more rows than tasks times replicates."""
    plan = replicates.bootstrap_moments(table, 2000, 3, ["id"], ["y", "x"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
