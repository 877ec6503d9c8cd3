import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators import linmod, mixed, neighbours
from cohortloom.plans import markers


def lmm_data(seed=1, subjects=60, slope=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        b0, b1 = rng.normal(0, 3), rng.normal(0, 1.0) if slope else 0.0
        start = rng.uniform(0, 1)
        for v in range(rng.integers(2, 7)):
            t = start + v * 0.5
            rows.append((s, t, s % 2, 40 + b0 + (b1 - 2) * t + 0.7 * (s % 2) + rng.normal(0, 1)))
    return pd.DataFrame(rows, columns=["s", "t", "c", "y"])


def reml(pdf, xs, theta, slope):
    """Textbook restricted deviance with the full covariance matrix."""
    x = np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in xs]])
    y = pdf.y.to_numpy()
    lam = np.array([[theta[0]]]) if not slope else np.array([[theta[0], 0], [theta[1], theta[2]]])
    v = np.eye(len(pdf))
    for s in pdf.s.unique():
        idx = np.where(pdf.s == s)[0]
        z = np.ones((len(idx), 1)) if not slope else np.column_stack([np.ones(len(idx)), pdf.t.to_numpy()[idx]])
        v[np.ix_(idx, idx)] += z @ lam @ lam.T @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    rss, dof = r @ vi @ r, len(y) - x.shape[1]
    dev = np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + dof * (1 + np.log(2 * np.pi * rss / dof))
    return dev, beta, np.linalg.inv(a) * rss / dof, vi, r, lam


def test_random_intercept_against_full_matrix(spark):
    pdf = lmm_data(slope=False)
    df = spark.createDataFrame(pdf)
    fit, table = mixed.fit_random_intercept(df, "s", "y", ["t", "c"])
    dev, beta, cov, vi, r, lam = reml(pdf, ["t", "c"], fit.theta, False)
    assert fit.deviance == pytest.approx(dev, rel=1e-9)
    assert np.allclose(fit.beta, beta)
    assert np.allclose(fit.covariance, cov)
    for factor in (0.97, 1.03):
        assert reml(pdf, ["t", "c"], [fit.theta[0] * factor], False)[0] >= dev - 1e-9
    dev_out = mixed.predicted_deviations(fit, table).toPandas().set_index("s").intercept_dev
    assert abs(dev_out.sum()) < 1e-6
    idx = np.where(pdf.s == 3)[0]
    want = lam[0, 0] ** 2 * np.ones(len(idx)) @ (vi @ r)[idx]
    assert dev_out.loc[3] == pytest.approx(want)


def test_random_slope_against_full_matrix(spark):
    pdf = lmm_data()
    df = spark.createDataFrame(pdf)
    fit, table = mixed.fit_random_slope(df, "s", "y", ["t"], "t")
    dev, beta, cov, vi, r, lam = reml(pdf, ["t"], fit.theta, True)
    assert fit.deviance == pytest.approx(dev, rel=1e-9)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.covariance, cov)
    rng = np.random.default_rng(0)
    for _ in range(30):
        near = np.array(fit.theta) + rng.normal(0, 0.03, 3)
        assert reml(pdf, ["t"], near, True)[0] >= dev - 1e-5
    got = mixed.predicted_deviations(fit, table).toPandas().set_index("s")
    idx = np.where(pdf.s == 5)[0]
    z = np.column_stack([np.ones(len(idx)), pdf.t.to_numpy()[idx]])
    want = lam @ lam.T @ z.T @ (vi @ r)[idx]
    assert got.loc[5, "intercept_dev"] == pytest.approx(want[0])
    assert got.loc[5, "slope_dev"] == pytest.approx(want[1])


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "x1": rng.normal(1e4, 1, 200), "x2": rng.integers(0, 2, 200) * 1.0})
    pdf["y"] = 3 * pdf.x1 - pdf.x2 + rng.normal(size=200)
    got = linmod.fit_ols(spark.createDataFrame(pdf), ["g"], "y", ["x1", "x2"]).toPandas()
    for g, part in pdf.groupby("g"):
        x = np.column_stack([np.ones(len(part)), part.x1 - 1e4, part.x2])
        beta, *_ = np.linalg.lstsq(x, part.y, rcond=None)
        res = part.y - x @ beta
        se = np.sqrt(res @ res / (len(part) - 3) * np.diag(np.linalg.inv(x.T @ x)))
        mine = got[got.g == g].set_index("term")
        assert np.allclose(mine.loc[["x1", "x2"], "estimate"], beta[1:], rtol=1e-6)
        assert np.allclose(mine.loc[["x1", "x2"], "std_error"], se[1:], rtol=1e-6)


def test_ols_constant_regressor_alone_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("a", 1.0, 9.0)], "g string, x double, y double")
    found = {r.term: r for r in linmod.fit_ols(df, ["g"], "y", ["x"]).collect()}
    assert found["x"].estimate is None and found["x"].std_error is None
    assert found["intercept"].estimate == 4.5 and found["intercept"].df == 3


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"b": np.repeat([0, 1], 150), "x": rng.normal(size=300), "z": rng.integers(0, 2, 300) * 1.0})
    pdf["y"] = (rng.random(300) < 1 / (1 + np.exp(-(0.5 * pdf.x - 0.3)))).astype(int)
    got = linmod.fit_logistic(spark.createDataFrame(pdf), ["b"], "y", ["x", "z"]).toPandas()
    for b, part in pdf.groupby("b"):
        x = np.column_stack([np.ones(len(part)), part.x, part.z])
        beta = np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ beta))
            info = x.T @ (x * (mu * (1 - mu))[:, None])
            beta = beta + np.linalg.solve(info, x.T @ (part.y - mu))
        mine = got[got.b == b].set_index("term").loc[["intercept", "x", "z"]]
        assert np.allclose(mine.estimate, beta, atol=1e-7)
        assert np.allclose(mine.std_error, np.sqrt(np.diag(np.linalg.inv(info))), atol=1e-6)


def test_logistic_separated_is_null(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    assert all(r.estimate is None for r in linmod.fit_logistic(df, [], "y", ["x"]).collect())


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 20, (6, 4))
    x = centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, 4))
    x[::3] = x[0]  # a third of all rows are copies of one vector
    x[40] = x[41]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.exact_neighbours(df, "id", "v", 4, block_rows=20, pivots=8).toPandas()
    assert len(got) == 300 * 4
    for i in (0, 1, 40, 41, 99, 250):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(300), d))[:4]
        mine = got[got.id == i].sort_values("rank")
        assert mine.neighbour.tolist() == want.tolist()
        assert np.allclose(mine.distance, d[want])


def test_distribution_tails():
    # exact values: t with 1 df is Cauchy, with 2 df algebraic; chi2 with 2 df is exponential
    t = np.array([0.5, 1.0, 3.0, 30.0])
    assert np.allclose(dist.t_two_sided(t, np.ones(4)), 1 - 2 / np.pi * np.arctan(t), rtol=1e-10)
    assert np.allclose(dist.t_two_sided(t, 2 * np.ones(4)), 1 - t / np.sqrt(2 + t * t), rtol=1e-10)
    x = np.array([0.1, 1.0, 5.0, 40.0])
    assert np.allclose(dist.chi2_upper(x, 2.0), np.exp(-x / 2), rtol=1e-10)
    assert np.allclose(dist.f_upper(t**2, 1.0, 7.0), dist.t_two_sided(t, 7 * np.ones(4)), rtol=1e-10)
    assert dist.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05, rel=1e-9)
    assert dist.trigamma(np.array([1.0]))[0] == pytest.approx(np.pi**2 / 6, rel=1e-10)
    assert dist.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, rel=1e-10)
    assert dist.inverse_trigamma(float(dist.trigamma(np.array([2.7]))[0])) == pytest.approx(2.7, rel=1e-8)


def test_p_value_columns(spark):
    df = spark.createDataFrame([(2.0, 5.0), (None, 5.0), (1.0, 0.0)], "t double, d double")
    got = [r[0] for r in df.select(dist.t_p_value(F.col("t"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(0.10193947, rel=1e-6) and got[1] is None and got[2] is None


def test_absent_counts_are_zeros(spark):
    """A sparse count matrix gives the same values and models as one with its zeros written."""
    rng = np.random.default_rng(3)
    rows = []
    for f in range(40):
        for s in range(20):
            mean = 50.0 if f < 10 else (0.0 if s % 2 else 20.0) if f < 20 else 6.0
            rows.append((s, f"f{f:02d}", float(rng.poisson(rng.gamma(4, mean / 4)) if mean else 0) + (1.0 if f < 10 else 0.0)))
    dense = spark.createDataFrame(rows, "sample int, feature string, value double")
    samples = spark.createDataFrame([(s, s % 2, s % 3, float(s)) for s in range(20)], "sample int, y int, batch int, age double")
    sparse = dense.where("value > 0")
    assert sparse.count() < dense.count()
    fits = [markers.omics_differential(d, "sample", "feature", "value", samples, "y", "batch", ["age"], kind).toPandas().set_index("feature").sort_index()
            for kind in ("counts", "intensity") for d in (dense, sparse)]
    for a, b in ((fits[0], fits[1]), (fits[2], fits[3])):
        assert list(a.index) == list(b.index) and len(a)
        assert np.allclose(a.log_fc.astype(float), b.log_fc.astype(float)) and np.allclose(a.t.astype(float), b.t.astype(float))


def test_saturated_fit_has_coefficients(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    got = {r.term: r for r in linmod.fit_ols(df, [], "y", ["x"]).collect()}
    assert got["x"].estimate == pytest.approx(2.0) and got["x"].std_error is None


def test_infinite_prior_pools_the_variances(spark):
    fits = spark.createDataFrame([(f"f{i}", 1.0, 0.5, 2.0, 4.0) for i in range(6)], "feature string, log_fc double, unscaled_var double, sigma2 double, df double")
    d0, s0 = linmod.variance_prior(fits)
    assert np.isinf(d0) and s0 == pytest.approx(2.0)
    got = linmod.moderate(fits, d0, s0).first()
    assert got.total_df == 24.0 and got.t == pytest.approx(1.0)
    assert linmod.moderate(fits, 50.0, 2.0).first().total_df == 24.0


def test_chi_square_with_many_degrees_of_freedom():
    assert float(dist.chi2_upper(np.array([1e6]), np.array([1e6]))[0]) == pytest.approx(0.499812, abs=2e-6)


def test_pivots_are_not_cut_and_all_vectors_are_asked(spark, monkeypatch):
    from study.catalog import ORACLES, QUERIES

    rng = np.random.default_rng(8)
    v = np.vstack([rng.normal(c, 0.3, size=(150, 3)) for c in range(0, 30, 5)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, v array<double>")
    seen, whole = set(), neighbours.materialize

    def spied(table, name):
        out = whole(table, name)
        if name == "knn-blocks":
            seen.update(r[0] for r in out.select("_cell").distinct().collect())
        return out

    monkeypatch.setattr(neighbours, "materialize", spied)
    got = neighbours.exact_neighbours(df, "id", "v", 3, block_rows=10, pivots=100).orderBy("id", "rank").toPandas()
    assert len(seen) == 100
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (got.neighbour.to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert "label" not in ORACLES["nearest_neighbours_all"]
    assert QUERIES["nearest_neighbours_all"](spark, folder).count() == 5 * n
