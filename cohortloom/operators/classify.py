"""Random-forest classification with repeated stratified cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.operators.ranks import rank_auc
from cohortloom.operators.resample import smote, stratified_folds, upsample
from cohortloom.storage import materialize


def with_vector(df: DataFrame, array: str = "features", out: str = "vector") -> DataFrame:
    """The ML boundary: an array column as a vector."""
    return df.withColumn(out, array_to_vector(array))


def forest(n_trees: int = 100, features_per_split: str = "sqrt", max_depth: int = 10, seed: int = 42,
           vector: str = "vector", label: str = "y") -> Pipeline:
    """Centre, scale, random forest."""
    scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True)
    trees = RandomForestClassifier(
        featuresCol="_scaled", labelCol=label, numTrees=n_trees, maxDepth=max_depth,
        featureSubsetStrategy=features_per_split, seed=seed,
    )
    return Pipeline(stages=[scaler, trees])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Probability of the positive class and the class at 0.5."""
    prob = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, prob.alias("prob")).withColumn(
        "predicted", (F.col("prob") > 0.5).cast("int"))


def confusion(df: DataFrame, by: Sequence[str], y: str, predicted: str) -> DataFrame:
    """Sensitivity, specificity and predictive values; NULL without cases."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(predicted) == b))
    counts = df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fn"),
                                 cell(0, 0).alias("tn"), cell(0, 1).alias("fp"))
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.withColumns({
        "sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp),
        "ppv": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn),
    })


def auc_summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and SD of the AUC over resamples."""
    return per_fold.groupBy(*by).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"),
                                     F.count("auc").alias("n_folds"))


def balanced(train: DataFrame, key: str, y: str, how: Sequence[str], seed: int, array: str = "features") -> DataFrame:
    """Training rows balanced by synthetic minority rows (``smote``), copies (``up``), or both in turn."""
    out = train.select(key, y, array)
    if "smote" in how:
        made = smote(out, key, array, y, 5, seed)
        out = out.unionByName(made.select(key, y, array))
    if "up" in how:
        # several rows of one key are told apart by their values
        ranked = out.withColumn("_row", F.xxhash64(array))
        out = upsample(ranked, [], y, [key, "_row"], seed).drop("copy", "_row")
    return out


def cross_validate(df: DataFrame, key: str, y: str, grid: Sequence[str], folds: int = 5, repeats: int = 5,
                   n_trees: int = 100, seed: int = 42, balance: Sequence[str] = ("up",),
                   array: str = "features") -> DataFrame:
    """Held-out scores of every grid value and fold: (setting, repeat, fold, key, y, prob).

    Balancing touches the training rows of a fold only, so no synthetic row or
    copy can leak into the rows that judge it.  The loop runs over model fits
    (settings x repeats x folds), each a distributed job.
    """
    assigned = stratified_folds(df.select(key, y, array), y, [key], folds, repeats, seed).persist()
    out = None
    try:
        for repeat in range(repeats):
            for fold in range(folds):
                here = assigned.where(F.col("repeat") == repeat)
                train, held = here.where(F.col("fold") != fold), here.where(F.col("fold") == fold)
                # read by every pass of every tree: written once
                train = materialize(balanced(train, key, y, balance, seed, array), "fold-train")
                train, held = with_vector(train, array), with_vector(held, array)
                for setting in grid:
                    model = forest(n_trees, setting, seed=seed, label=y).fit(train)
                    part = score(model, held, [key, y]).select(
                        F.lit(setting).alias("setting"), F.lit(repeat).alias("repeat"),
                        F.lit(fold).alias("fold"), key, y, "prob")
                    out = part if out is None else out.unionByName(part)
    finally:
        assigned.unpersist()
    return out


def tune(scores: DataFrame, y: str) -> DataFrame:
    """Mean and SD of the held-out AUC per setting, best first."""
    per_fold = rank_auc(scores, ["setting", "repeat", "fold"], "prob", y)
    return auc_summary(per_fold, ["setting"]).orderBy(F.desc("auc_mean"), "setting")


def importance_table(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """Feature importances (one number per feature of the panel)."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, raw double")


def scale_0_100(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - min) / (max - min) * 100 over the table."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, share * 100).drop("_lo", "_hi")  # one row


def score_band(score_column: Column) -> Column:
    """Band of a feature score."""
    edges = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
    band = F.when(score_column < edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:]):
        band = band.when(score_column < high, f"{low}-{high}")
    return band.when(score_column.isNotNull(), f">{edges[-1]}")
