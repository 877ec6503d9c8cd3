"""The dense matrix without a shuffle of its cells, and neighbours by blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import neighbours, tables


@pytest.mark.parametrize("block", [4096, 2])
def test_every_cell_once(spark, monkeypatch, block):
    monkeypatch.setattr(tables, "_FEATURES_IN_BLOCK", block)
    monkeypatch.setattr(tables, "_BROADCAST_BLOCKS", 1)
    rows = [("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.0), ("b", "x", 3.0), (None, "x", 4.0), ("c", None, 5.0), ("d", "z", 6.0)]
    df = spark.createDataFrame(rows, "s string, f string, v double")
    for left, right in ((None, None), (spark.createDataFrame([("a",), ("e",), (None,)], "s string"), spark.createDataFrame([("x",), ("w",)], "f string"))):
        got = tables.complete_grid(df, "s", "f", "v", left, right)
        ls = df if left is None else left
        fs = df if right is None else right
        grid = ls.select("s").distinct().crossJoin(fs.select("f").distinct())
        want = grid.join(df.withColumn("there", F.lit(True)), ["s", "f"], "left").select("s", "f", F.when(F.col("there"), F.col("v")).otherwise(0.0).alias("v"))
        assert got.schema["v"].dataType == want.schema["v"].dataType
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cells_are_not_shuffled(spark):
    df = spark.range(4000).select((F.col("id") % 200).alias("s"), F.col("id").alias("f"), F.lit(1.0).alias("v"))
    plan = tables.complete_grid(df, "s", "f", "v")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    above = [line for line in lines[:made] if "Exchange" in line]
    assert not above


def test_neighbours_with_copies_ties_and_far_rows(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(120, 5)), 1e6 + rng.normal(size=(60, 5)), np.zeros((30, 5)), rng.integers(0, 3, size=(60, 5))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": v.tolist()}))
    want = []
    for i, row in enumerate(v):
        d = np.sqrt(((v - row) ** 2).sum(axis=1))
        d[i] = np.inf
        want.append(np.argsort(d, kind="stable")[:4].tolist())
    for size in (16, 8192):
        got = neighbours.exact_neighbours(df, "id", "v", 4, block_rows=size).orderBy("id", "rank").toPandas()
        assert got.groupby("id").neighbour.apply(list).tolist() == want


def test_visits_go_to_few_blocks():
    """Candidates hold the nearest rows and little else."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 8))
    near = list(neighbours._candidates(v[:20], v, np.arange(20), np.arange(500), 3))
    for i, at in enumerate(near):
        d = ((v - v[i]) ** 2).sum(axis=1)
        assert set(np.argsort(d)[:4]) <= set(at) and len(at) < 10


def test_written_matrix_is_small(spark, tmp_path):
    """The cells of a task come in an order that a columnar writer can fold."""
    df = spark.range(3000).select((F.col("id") % 300).alias("s"), F.concat(F.lit("feature "), F.col("id").cast("string")).alias("f"), F.lit(2.0).alias("v"))
    tables.complete_grid(df, "s", "f", "v").write.parquet(str(tmp_path / "grid"))
    size = sum(p.stat().st_size for p in (tmp_path / "grid").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 900_000
    assert size < 0.6 * 900_000


def test_columns_of_each_cell(spark):
    """What depends on the value is computed once for all absent cells of a row in a block, with the same result."""
    rows = [("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.0), ("b", "x", 3.0), (None, "x", 4.0), ("c", None, 5.0), ("d", "z", 6.0)]
    df = spark.createDataFrame(rows, "s string, f string, v double")
    shifted = lambda cells: cells.withColumn("w", F.col("v") + 1).withColumn("u", F.col("v").isNull())
    got = tables.complete_grid(df, "s", "f", "v", each=shifted)
    want = shifted(tables.complete_grid(df, "s", "f", "v"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_held_cells_in_a_tile(spark):
    df = spark.range(1200).where("id % 3 <> 1").select(F.lit("r").alias("s"), F.col("id").alias("f"), F.lit(1.0).alias("v"))
    wide = spark.range(1200).select(F.col("id").alias("f"))
    got = tables.complete_grid(df, "s", "f", "v", features=wide).orderBy("f").toPandas()
    assert got.f.tolist() == list(range(1200)) and got.v.tolist() == [float(i % 3 != 1) for i in range(1200)]
