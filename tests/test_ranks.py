import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import ranks


def frame(seed=3, n=400):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    return pd.DataFrame({
        "id": np.arange(n), "g": group,
        "v": np.round(rng.normal(size=n), 1),
        "y": (rng.random(n) < 0.4).astype(int),
    })


@pytest.mark.parametrize("sliced", [False, True])
def test_numbering_matches_sorted_position(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    pdf = frame()
    df = spark.createDataFrame(pdf)
    assert (ranks.slice_groups(df, ["g"], ["v", "id"]) is not None) == sliced
    got = ranks.number_rows(df, ["g"], ["v", "id"], "rn", total="n").toPandas()
    want = pdf.sort_values(["g", "v", "id"]).assign(rn=lambda d: d.groupby("g").cumcount() + 1)
    merged = got.merge(want[["id", "rn"]], on="id")
    assert len(got) == len(pdf)
    assert (merged.rn_x == merged.rn_y).all()
    assert (got.groupby("g").size() == got.groupby("g").n.first()).all()


@pytest.mark.parametrize("sliced", [False, True])
def test_quantiles_match_numpy(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    pdf = frame(5)
    got = ranks.exact_quantiles(
        spark.createDataFrame(pdf), ["g"], "v", {"q0": 0.0, "q1": 1 / 3, "q2": 0.8, "q3": 1.0}
    ).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        want = np.quantile(part.v, [0, 1 / 3, 0.8, 1])
        assert np.allclose(got.loc[g, ["q0", "q1", "q2", "q3"]].astype(float), want)


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)[::-1]
    n = len(p)
    q = np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1))
    out = np.empty(n)
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("sliced", [False, True])
def test_fdr_matches_closed_form(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"f": np.arange(200), "p": np.round(rng.random(200) ** 3, 3)})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(999, None)], "f long, p double"))
    got = ranks.adjust_fdr(df, [], "p", ["f"], "q").toPandas().set_index("f")
    assert np.isnan(got.loc[999, "q"])
    assert np.allclose(got.loc[pdf.f, "q"].astype(float), bh(pdf.p))
    assert (got.loc[pdf.f, "q"] >= got.loc[pdf.f, "p"] - 1e-12).all()


def test_fdr_all_equal(spark):
    df = spark.createDataFrame([(i, 0.03) for i in range(10)], "f int, p double")
    got = ranks.adjust_fdr(df, [], "p", ["f"], "q").toPandas()
    assert np.allclose(got.q, 0.03)


@pytest.mark.parametrize("sliced", [False, True])
def test_auc_matches_pair_counting(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    pdf = frame(9)
    df = spark.createDataFrame(pdf)
    got = ranks.rank_auc(df, ["g"], "v", "y").toPandas().set_index("g")
    flipped = ranks.rank_auc(df.withColumn("v", -F.col("v")), ["g"], "v", "y").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        pos, neg = part.v[part.y == 1].to_numpy(), part.v[part.y == 0].to_numpy()
        diff = pos[:, None] - neg[None, :]
        want = ((diff > 0) + 0.5 * (diff == 0)).mean()
        assert got.loc[g, "auc"] == pytest.approx(want)
        assert flipped.loc[g, "auc"] == pytest.approx(1 - want)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert ranks.rank_auc(df, [], "s", "y").first().auc is None


def test_missing_group_key_is_a_group_when_sliced(spark, tiny_slices):
    df = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(120)], "g string, id int")
    got = ranks.number_rows(df, ["g"], ["id"], "rn", total="n").toPandas()
    assert len(got) == 120 and (got.n == 60).all()
    assert (got.rn == got.id // 2 + 1).all()
    low = ranks.later_minimum(df.withColumn("v", F.col("id") % 7), ["g"], ["id"], "v", "low").toPandas()
    for r in low.itertuples():
        assert r.low == min(i % 7 for i in range(r.id, 120, 2))


def test_explicit_plan_stays_on_one_shuffle_for_small_groups(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), "id")
    plan = ranks.number_rows(df, ["g"], ["id"], "rn")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_only_large_groups_are_sliced(spark):
    from cohortloom.operators.ranks import ROWS_SETTING, SLICE, slice_groups

    small = spark.range(20_000).select((F.col("id") % 10_000).alias("g"), F.col("id").alias("k"))
    one = spark.range(5_000).select(F.lit(-1).cast("long").alias("g"), (F.col("id") + 50_000).alias("k"))
    spark.conf.set(ROWS_SETTING, "1000")
    try:
        assert slice_groups(small, ["g"], ["k"]) is None
        sliced = slice_groups(small.unionByName(one), ["g"], ["k"])
        top = {r.large: r.top for r in sliced.groupBy((F.col("g") < 0).alias("large")).agg(F.max(SLICE).alias("top")).collect()}
        assert top[False] == 0 and top[True] >= 1
    finally:
        spark.conf.unset(ROWS_SETTING)
