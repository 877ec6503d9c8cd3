import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import classify, linmod, normalize, pca, resample
from cohortloom.plans import progression


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(200), "y": (rng.random(200) < 0.25).astype(int), "x": rng.normal(size=200)})
    return pdf, spark.createDataFrame(pdf)


def test_bootstrap_weights_look_like_poisson(people):
    _, df = people
    w = resample.bootstrap_rows(df, 50, 9, ["id"]).groupBy("b").agg(F.sum("w").alias("n")).toPandas()
    assert len(w) == 50 and abs(w.n.mean() - 200) < 8 and 8 < w.n.std() < 22
    again = resample.bootstrap_rows(df.repartition(3), 50, 9, ["id"]).groupBy("b").agg(F.sum("w").alias("n")).toPandas()
    assert w.sort_values("b").n.tolist() == again.sort_values("b").n.tolist()


def test_permutation_keeps_the_outcome_values(people):
    pdf, df = people
    out = resample.permuted_outcome(df, 5, 1, ["id"], "x").toPandas()
    for _, part in out.groupby("b"):
        assert np.allclose(np.sort(part.x), np.sort(pdf.x)) and len(part) == 200
        assert (part.sort_values("id").x.to_numpy() != pdf.x.to_numpy()).mean() > 0.9


@pytest.mark.parametrize("sliced", [False, True])
def test_split_and_folds_are_stratified(people, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    pdf, df = people
    split = resample.stratified_split(df, "y", ["id"], 0.7, 42).toPandas()
    for y, part in split.groupby("y"):
        assert part.is_train.sum() == int(np.ceil(0.7 * len(part)))
    folds = resample.stratified_folds(df, "y", ["id"], 5, 2, 42).toPandas()
    assert (folds.groupby(["repeat", "id"]).size() == 1).all()
    sizes = folds.groupby(["repeat", "y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_upsampling_balances(people):
    pdf, df = people
    out = resample.upsample(df, [], "y", ["id"], 3).toPandas()
    assert out.groupby("y").size().nunique() == 1 and set(out.id) == set(pdf.id)
    copies = out.groupby(["y", "id"]).size().groupby("y")
    assert (copies.max() - copies.min() <= 1).all()


def test_the_smaller_class_is_the_minority(spark):
    rows = [(i, [float(i), float(i % 7)], int(i >= 8)) for i in range(30)]
    out = resample.smote(spark.createDataFrame(rows, "id long, v array<double>, y int"), "id", "v", "y", 3, 1).toPandas()
    assert len(out) == 8 * ((30 - 8 - 8) // 8) and set(out.y) == {0} and out.id.max() < 8


def test_synthetic_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(size=3)], int(i < 12)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = resample.smote(df, "id", "v", "y", 5, 1).toPandas()
    assert len(out) == 12 * ((50 - 12 - 12) // 12)
    v = {i: np.array(x) for i, x, _ in rows}
    for r in out.itertuples():
        assert r.neighbour != r.id and r.neighbour < 12 and 0 <= r.gap < 1
        assert np.allclose(r.v, v[r.id] + r.gap * (v[r.neighbour] - v[r.id]))


def test_variance_prior_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    d0, s0, d = 6.0, 0.5, 20
    true = d0 * s0 / rng.chisquare(d0, 20000)
    s2 = true * rng.chisquare(d, 20000) / d
    df = spark.createDataFrame(pd.DataFrame({"sigma2": s2, "df": float(d)}))
    got_d0, got_s0 = linmod.variance_prior(df)
    assert got_d0 == pytest.approx(d0, rel=0.08) and got_s0 == pytest.approx(s0, rel=0.03)
    flat = spark.createDataFrame(pd.DataFrame({"sigma2": rng.chisquare(d, 5000) / d, "df": float(d)}))
    assert linmod.variance_prior(flat)[0] > 200


def test_dispersion_trend_recovers_parameters(spark):
    rng = np.random.default_rng(3)
    mean = np.exp(rng.uniform(1, 8, 3000))
    disp = (0.1 + 3.0 / mean) * rng.gamma(20, 1 / 20, 3000)
    df = spark.createDataFrame(pd.DataFrame({"mean": mean, "dispersion": disp}))
    a0, a1, settled = normalize.fit_dispersion_trend(df)
    assert settled
    assert a0 == pytest.approx(0.1, rel=0.05) and a1 == pytest.approx(3.0, rel=0.08)


def test_batch_removal_general_equals_intercept_form(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"f": np.repeat(["a", "b"], 60), "batch": np.tile(np.arange(3), 40), "v": rng.normal(size=120)})
    pdf["v"] += pdf.batch
    from cohortloom.operators.tables import sum_contrasts

    df = spark.createDataFrame(pdf.reset_index(names="i"))
    plain = normalize.remove_batch_means(df, "f", "batch", "v").toPandas().sort_values("i").adjusted
    coded = df.withColumns(sum_contrasts("batch", [0, 1, 2], "b"))
    general = normalize.remove_batch(coded, "f", "v", [], ["b1", "b2"]).toPandas().sort_values("i").adjusted
    assert np.allclose(plain, general)


def test_first_component_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = pca.project(pca.fit_components(df, "v"), df, "v").toPandas().sort_values("id").pc1.to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][0]
    assert np.allclose(np.abs(got), np.abs(want))


def test_forest_separates_and_metrics_agree(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(120) < 0.3).astype(int)
    rows = [(int(i), int(c), [float(v) for v in rng.normal(size=3) + 3 * c]) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, y int, features array<double>")
    scores = classify.cross_validate(df, "id", "y", ["sqrt"], folds=3, repeats=1, n_trees=10).toPandas()
    assert sorted(scores.id) == list(range(120))
    model = classify.forest(10).fit(classify.with_vector(df))
    out = classify.score(model, classify.with_vector(df), ["id", "y"])
    pdf = out.toPandas()
    m = classify.confusion(out, [], "y", "predicted").first()
    assert m.sensitivity == pytest.approx(pdf[pdf.y == 1].predicted.mean())
    assert m.specificity == pytest.approx(1 - pdf[pdf.y == 0].predicted.mean())
    imp = classify.scale_0_100(classify.importance_table(model, ["a", "b", "c"], spark), "raw", "imp").toPandas().imp
    assert imp.min() == 0 and imp.max() == 100


def test_robustness_checks_find_a_strong_effect(spark):
    rng = np.random.default_rng(11)
    pc = rng.normal(size=90)
    pdf = pd.DataFrame({"id": np.arange(90), "slope": -2 * pc + rng.normal(size=90) * 1.5, "pc1": pc, "sex": rng.integers(0, 2, 90)})
    out = progression.robustness_checks(spark.createDataFrame(pdf), "id", "slope", "pc1", ["sex"], replicates=16)
    lin = {r.check: r for r in out["intervals"].collect()}
    assert lin["linear"].high < 0 and lin["linear"].share_above == 0
    assert lin["odds_ratio"].low > 1
    perm = {r.check: r for r in out["permutations"].collect()}
    assert perm["linear"].p_value == 0 and perm["logistic"].p_value == 0


def test_component_queries_read_the_whole_vector(spark):
    from study.catalog import QUERIES
    from study.views import wide_measure

    folder = "/root/testdata/sf0.001"
    w = wide_measure(spark, folder).toPandas().sort_values("sample")
    x, y, visit = np.stack(w.features.to_numpy()), w.y.to_numpy(), w.visit.to_numpy()
    assert x.shape[1] == 64

    def scores(fitted, rows, labels):
        centre, spread = fitted.mean(axis=0), fitted.std(axis=0, ddof=1)
        loadings = np.linalg.svd((fitted - centre) / spread, full_matrices=False)[2][0]
        pc = (rows - centre) / spread @ loadings
        return pc if pc[labels == 1].mean() >= pc[labels == 0].mean() else -pc

    for name, fitted in (("first_component_all", x), ("baseline_component_projection_all", x[visit == 1])):
        got = QUERIES[name](spark, folder).toPandas().sort_values("sample").pc1.to_numpy()
        assert np.allclose(got, scores(fitted, x, y), atol=2e-6)
    models = QUERIES["marker_score_models"](spark, folder).where("term = 'y'").toPandas().set_index("grp").estimate
    for g in (0, 1):
        at = w["sample"].to_numpy() % 2 == g
        pc, design = scores(x[at], x[at], y[at]), np.column_stack([np.ones(at.sum()), y[at], w["sample"].to_numpy()[at] % 50])
        assert models[str(g)] == pytest.approx(np.linalg.lstsq(design, pc, rcond=None)[0][1], rel=1e-6)
