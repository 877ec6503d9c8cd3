"""Keyed bijections and the fits that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dist, draws
from cohortloom.operators import linmod, mixed, resample


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 97, 1000, 1009])
def test_every_replicate_is_a_bijection(spark, n):
    rows = spark.range(n).crossJoin(spark.range(6).select(F.col("id").alias("b")).withColumn("keys", draws.round_keys(9, F.col("b"))))
    sent = rows.select("id", "b", draws.permuted(F.col("id"), F.col("keys"), n).alias("to")).toPandas()
    for _, own in sent.groupby("b"):
        assert sorted(own["to"]) == list(range(n))
    if n >= 97:
        orders = {tuple(own.sort_values("id")["to"]) for _, own in sent.groupby("b")}
        assert len(orders) == 6
        for order in orders:  # a random order keeps about one place and has little correlation with the old one
            assert sum(i == t for i, t in enumerate(order)) <= 8
            assert abs(np.corrcoef(range(n), order)[0, 1]) < 0.4
    a, b = draws.sides(n)
    assert a * b >= n


def test_places_are_spread_evenly(spark):
    n, many = 60, 3000
    rows = spark.range(n).crossJoin(spark.range(many).select(F.col("id").alias("b")).withColumn("keys", draws.round_keys(4, F.col("b"))))
    cells = rows.select("id", draws.permuted(F.col("id"), F.col("keys"), n).alias("to")).groupBy("id", "to").count().toPandas()
    full = np.zeros((n, n))
    full[cells["id"], cells["to"]] = cells["count"]
    expected = many / n
    chi = ((full - expected) ** 2 / expected).sum()
    dof = (n - 1) ** 2
    assert abs(chi - dof) < 6 * np.sqrt(2 * dof)


@pytest.mark.parametrize("broadcast", [10, 1_000_000])
def test_outcomes_are_shuffled_within_replicates(spark, monkeypatch, broadcast):
    monkeypatch.setattr(resample, "_BROADCAST_OUTCOMES", broadcast)
    df = spark.createDataFrame([(i, float(i % 5), f"x{i}") for i in range(53)], "k long, y double, x string")
    got = resample.permuted_outcome(df.repartition(4), 20, 1, ["k"], "y").toPandas()
    assert len(got) == 53 * 20 and set(got.columns) == {"k", "x", "b", "y"}
    for _, own in got.groupby("b"):
        assert sorted(own["y"]) == sorted(float(i % 5) for i in range(53)) and own["k"].is_unique
    again = resample.permuted_outcome(df.repartition(2), 20, 1, ["k"], "y").toPandas()
    order = ["b", "k"]
    assert (got.sort_values(order)["y"].to_numpy() == again.sort_values(order)["y"].to_numpy()).all()
    assert resample.permuted_outcome(df.where("false"), 3, 1, ["k"], "y").count() == 0


def test_replicates_without_a_value_count(spark):
    obs = spark.createDataFrame([(2.0,)], "v double")
    reps = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None), (3, 0.5)], "b int, v double")
    r = resample.permutation_p(obs, reps, [], "v").first()
    assert (r.n_permutations, r.n_settled, r.p_value) == (4, 3, 0.5)
    i = resample.bootstrap_interval(reps, [], "v").first()
    assert (i.n_replicates, i.n_all) == (3, 4)


# ---- least squares that lose only the dependent term ----------------------------------

def test_collinear_and_constant_terms_alone_are_lost(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=40), rng.normal(size=40)
    y = 1 + 2 * x1 - x2 + rng.normal(size=40)
    rows = [("a", *map(float, (v, a, 3 * a - 1, b, 7.0, a + b))) for v, a, b in zip(y, x1, x2)]
    got = linmod.fit_ols(spark.createDataFrame(rows, "g string, y double, x1 double, c1 double, x2 double, one double, c2 double"), ["g"], "y", ["x1", "c1", "x2", "one", "c2"])
    found = {r.term: r for r in got.collect()}
    design = np.column_stack([np.ones(40), x1, x2])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = np.linalg.inv(design.T @ design) * rss[0] / 37
    for i, term in enumerate(["intercept", "x1", "x2"]):
        assert np.isclose(found[term].estimate, beta[i]) and np.isclose(found[term].std_error, np.sqrt(cov[i, i])) and found[term].df == 37
        assert np.isclose(found[term].unscaled, cov[i, i] / (rss[0] / 37)) and np.isclose(found[term].level, y.mean())
    assert all(found[t].estimate is None and found[t].std_error is None for t in ("c1", "one", "c2"))


def test_saturated_and_too_small_models(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("a", 3.0, 1.0, 1.0), ("b", 5.0, 2.0, 0.0)], "g string, y double, x double, z double")
    found = {(r.g, r.term): r for r in linmod.fit_ols(df, ["g"], "y", ["x", "z"]).collect()}
    assert np.isclose(found["a", "x"].estimate, 2) and found["a", "x"].std_error is None and found["a", "z"].estimate is None
    assert np.isclose(found["b", "intercept"].estimate, 5) and found["b", "x"].estimate is None


def test_many_replicates_settle_one_by_one(spark):
    rows = [(b, int((i * 7 + b) % 3 == 0), float(i % 4), 1 + (i + b) % 2) for b in range(5) for i in range(60)]
    rows += [(9, int(i >= 30), float(i), 1) for i in range(60)]  # classes that can be told apart
    df = spark.createDataFrame(rows, "b int, y int, x double, w int")
    fits = linmod.fit_logistic(df, ["b"], "y", ["x"], weight="w").where("term = 'x'").collect()
    assert len(fits) == 6
    for r in fits:
        assert r.converged == (r.b != 9) and (r.estimate is None) == (r.b == 9)
        if r.b != 9:
            own = [t for t in rows if t[0] == r.b]
            y, x, w = (np.array([t[i] for t in own], float) for i in (1, 2, 3))
            design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
            for _ in range(50):
                mu = 1 / (1 + np.exp(-design @ beta))
                beta += np.linalg.solve((design * (w * mu * (1 - mu))[:, None]).T @ design, design.T @ (w * (y - mu)))
            assert np.isclose(r.estimate, beta[1], atol=1e-7) and r.n == w.sum()


# ---- tails and effect variance ---------------------------------------------------------

def test_beta_fraction_and_t_quantiles():
    assert abs(float(dist.regularized_beta(5e7, 5e7, 0.49999)) - 0.42074) < 1e-5
    p, df = np.array([0.9, 0.05, 1e-6, 1e-40]), np.array([3.0, 10.0, 200.0, 5.0])
    t = dist.t_upper_quantile(p, df)
    assert np.allclose(dist.t_two_sided(t, df), p, rtol=1e-9)
    assert np.isclose(dist.t_upper_quantile(np.array([0.05]), np.array([10.0]))[0], 2.2281388519649385)


def test_effect_variance_against_plain_numbers(spark):
    rng = np.random.default_rng(4)
    t = np.concatenate([rng.standard_t(12, 900), rng.normal(0, 6, 100)])
    u = rng.uniform(0.01, 0.1, 1000)
    df = spark.createDataFrame([(f"f{i}", float(a), 12.0, float(b)) for i, (a, b) in enumerate(zip(t, u))], "f string, t double, total_df double, unscaled_var double")
    for share in (0.01, 0.2):
        keep = int(np.ceil(1000 * share / 2))
        order = np.argsort(-np.abs(t), kind="stable")[:keep]
        p0 = dist.t_two_sided(np.abs(t[order]), np.full(keep, 12.0))
        target = ((np.arange(keep) + 0.5) / 1000 - (1 - share) * p0) / share
        own = np.zeros(keep)
        good = target > p0
        own[good] = np.maximum(0, u[order][good] * ((np.abs(t[order][good]) / dist.t_upper_quantile(target[good], np.full(good.sum(), 12.0))) ** 2 - 1))
        want = np.clip(own, 0.01 / 0.5, 16 / 0.5).mean()
        assert np.isclose(linmod.effect_variance(df, "f", 0.5, share), want, rtol=1e-9)


def test_random_intercept_bracket_widens(spark):
    rng = np.random.default_rng(6)
    rows = [(s, float(x), float(1e4 * (s % 7) + x + 0.05 * rng.normal())) for s in range(30) for x in range(4)]
    fit, _ = mixed.fit_random_intercept(spark.createDataFrame(rows, "s int, x double, y double"), "s", "y", ["x"])
    assert fit.converged and fit.theta[0] > 1e4
    assert abs(fit.beta[1] - 1) < 0.05
