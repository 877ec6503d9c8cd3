import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import information, replicates


def ent(y):
    n = len(y)
    if n == 0:
        return 0.0
    p = np.bincount(y, minlength=2) / n
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def recursive_gain(x, y):
    """Fayyad-Irani by recursion, nats: total size-weighted gain of accepted splits."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(y)
    best = None
    for i in range(1, n):
        if x[i] == x[i - 1]:
            continue
        after = round((i * ent(y[:i]) + (n - i) * ent(y[i:])) / n, 12)
        if best is None or after < best[0]:
            best = (after, i)
    if best is None:
        return 0.0
    after, i = best
    k, k1, k2 = (len(set(v.tolist())) for v in (y, y[:i], y[i:]))
    delta = np.log(3.0**k - 2) - (k * ent(y) - k1 * ent(y[:i]) - k2 * ent(y[i:]))
    gain = ent(y) - after
    if gain <= (np.log(n - 1) + delta) / n:
        return 0.0
    return n * gain + recursive_gain(x[:i], y[:i]) + recursive_gain(x[i:], y[i:])


def table(n=240, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.35).astype(int)
    columns = {
        "noise": rng.normal(size=n),
        "shift": rng.normal(size=n) + 1.5 * y,
        "middle": np.where(y == 1, rng.normal(0, 0.3, n), rng.normal(0, 3, n)),
        "coarse": np.round(rng.normal(size=n) + y, 0),
        "constant": np.ones(n),
    }
    wide = pd.DataFrame({"s": np.arange(n), "y": y, **columns})
    return wide.melt(["s", "y"], var_name="f", value_name="v")


@pytest.mark.parametrize("sliced", [False, True])
def test_gain_matches_recursion(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    pdf = table()
    got = information.information_gain(spark.createDataFrame(pdf), "f", "v", "y").toPandas().set_index("f").importance
    for f, part in pdf.groupby("f"):
        want = recursive_gain(part.v.to_numpy(), part.y.to_numpy()) / len(part)
        assert got[f] == pytest.approx(want, abs=1e-9)
    assert got["constant"] == 0 and got["shift"] > 0 and got["middle"] > 0


def test_mutual_information_bounds_and_value(spark):
    pdf = table(seed=3)
    got = information.mutual_information(spark.createDataFrame(pdf), ["f"], "v", "y").toPandas().set_index("f").mi
    for f, part in pdf.groupby("f"):
        before = part.v.apply(lambda v: (part.v < v).sum())
        bins = (before * 5 // len(part)).to_numpy()
        joint = pd.crosstab(bins, part.y.to_numpy()).to_numpy() / len(part)
        expected = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        want = (joint[joint > 0] * np.log(joint[joint > 0] / expected[joint > 0])).sum()
        assert got[f] == pytest.approx(want, abs=1e-12)
        assert -1e-12 <= got[f] <= ent(part.y.to_numpy()) + 1e-12


def test_fixed_bins_agree_with_rebinning_when_every_value_is_frequent(spark):
    """With few distinct values both ways of binning see the same bins in most resamples."""
    pdf = table(seed=5)
    df = spark.createDataFrame(pdf[pdf.f == "constant"])
    a = information.resampled_information(df, "s", "f", "v", "y", 8, 1, rebin=True).toPandas()
    b = information.resampled_information(df, "s", "f", "v", "y", 8, 1, rebin=False).toPandas()
    assert len(a) == len(b) == 8
    assert np.allclose(a.sort_values("b").mi, 0) and np.allclose(b.sort_values("b").mi, 0)


def _odd_rows(spark):
    """Ties, a value of most rows, NaN, both zeros, missing values, classes, samples and features, a sample that comes twice."""
    rng = np.random.default_rng(11)
    rows = []
    for f, size in (("a", 90), (None, 60), ("tied", 120), ("short", 5)):
        for i in range(size):
            v = float(np.round(rng.normal(), 1 if f != "a" else 6))
            rows.append((i % 80 if i % 13 else None, f, 0.25 if f == "tied" and i % 4 else v, int(rng.integers(2))))
    rows += [(s, "a", v, s % 2) for s, v in ((1, float("nan")), (2, float("nan")), (3, 0.0), (4, -0.0), (5, None))] + [(6, "a", 1.0, None)]
    return spark.createDataFrame(rows, "s long, f string, v double, y int").repartition(3)


def _row_by_row(df, n, seed):
    """The scores from a row per row and replicate."""
    spread = information._expand_slots(information._replicate_blocks(df, n, seed, "s"), n, ["f", "v", "y"])
    return information.mutual_information(spread, ["f", "b"], "v", "y", 5, "w")


def _assert_equal_scores(got, want):
    key = lambda r: (r.f or "", r.b)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and got
    assert [r.mi for r in got] == pytest.approx([r.mi for r in want], abs=1e-12)


@pytest.mark.parametrize("n", [1, 10])
def test_resampled_bins_equal_the_rows(spark, n):
    df = _odd_rows(spark)
    got, want = information.resampled_information(df, "s", "f", "v", "y", n, 3), _row_by_row(df, n, 3)
    assert got.dtypes == want.dtypes
    _assert_equal_scores(got, want)
    exact = df.withColumn("v", F.col("v").cast("decimal(20,3)")).where("v is not null")
    _assert_equal_scores(information.resampled_information(exact, "s", "f", "v", "y", n, 3), _row_by_row(exact, n, 3))


def test_resampled_bins_equal_the_rows_in_slices(spark, tiny_slices):
    df = _odd_rows(spark)
    _assert_equal_scores(information.resampled_information(df, "s", "f", "v", "y", 10, 3), _row_by_row(df, 10, 3))


def test_resampled_bins_hold_few_weights_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    rows = pa.table({"_v": rng.normal(size=900).round(1), "_y": rng.integers(0, 2, 900), "_w": [(rng.integers(0, 256, 5, np.uint8) & 0x33).tobytes() for _ in range(900)]})
    listed = lambda: [r for part in replicates._bin_sums(rows, 9, 5) for r in zip(*(c.tolist() for c in part))]
    whole = listed()
    monkeypatch.setattr(replicates, "_WEIGHTS_HELD", 1000)
    monkeypatch.setattr(replicates, "_STRETCH", 7)
    assert whole == listed() and {r[0] for r in whole} == set(range(9))


def test_no_row_per_row_and_replicate(spark):
    """More resamples make no more rows before the bins: the plan multiplies none."""
    plan = information.resampled_information(_odd_rows(spark), "s", "f", "v", "y", 100, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_stability_prefers_informative_features(spark):
    pdf = table(seed=7)
    for rebin in (True, False):
        out = information.information_stability(spark.createDataFrame(pdf), "s", "f", "v", "y", n=8, top_k=2, rebin=rebin)
        got = out.toPandas().set_index("f")
        assert got.loc["shift", "sel_freq"] == 1.0
        assert got.sel_freq.sum() == pytest.approx(2.0)


def test_group_tags(spark):
    rows = lambda hi: spark.createDataFrame([(f"f{i}", 0.9 if i in hi else 0.1 + i / 1000, 1.0 if i in hi else 0.2) for i in range(10)],
                                            "f string, mi_median double, sel_freq double")
    stab = {"a": rows({1, 2}), "b": rows({2, 3}), "c": rows({2, 4})}
    full = {g: d.select("f", F.col("mi_median").alias("mi")) for g, d in stab.items()}
    got = information.compare_groups(stab, full, "f", ("shared", "a", "b", "c", "other")).toPandas().set_index("f").category
    assert got["f2"] == "shared" and got["f1"] == "a" and got["f3"] == "b" and got["f4"] == "c" and got["f0"] == "other"
