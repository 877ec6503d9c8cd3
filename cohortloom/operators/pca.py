"""First principal component of a small panel of chosen features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


def fit_components(df: DataFrame, array: str, k: int = 1, center: bool = True, scale: bool = True) -> PipelineModel:
    """Fit on the rows of ``df``; the model keeps centre, scale and loadings."""
    vectors = df.select(array_to_vector(array).alias("_vector"))
    scaler = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=center, withStd=scale)
    return Pipeline(stages=[scaler, PCA(k=k, inputCol="_scaled", outputCol="_pc")]).fit(vectors)


def project(model: PipelineModel, df: DataFrame, array: str, out: str = "pc1") -> DataFrame:
    """Scores on the fitted first component, for the same or other rows."""
    scored = model.transform(df.withColumn("_vector", array_to_vector(array)))
    return scored.withColumn(out, vector_to_array("_pc")[0]).drop("_vector", "_scaled", "_pc")


def orient_by_outcome(df: DataFrame, score: str, outcome: str, sign: int = -1) -> DataFrame:
    """Flip the score, if needed, so that it correlates with the outcome in the given sense."""
    together = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).agg(
        F.covar_pop(score, outcome).alias("_cov"))
    flip = F.when(F.col("_cov") * F.lit(sign) < 0, -1.0).otherwise(1.0)
    return df.crossJoin(F.broadcast(together)).withColumn(score, F.col(score) * flip).drop("_cov")  # one row


def orient_by_group(df: DataFrame, score: str, y: str) -> DataFrame:
    """Flip the score, if needed, so that the mean of y = 1 is not below that of y = 0."""
    means = df.agg(F.avg(F.when(F.col(y) == 1, F.col(score))).alias("_pos"),
                   F.avg(F.when(F.col(y) == 0, F.col(score))).alias("_neg"))
    flip = F.when(F.col("_pos") < F.col("_neg"), -1.0).otherwise(1.0)
    return df.crossJoin(F.broadcast(means)).withColumn(score, F.col(score) * flip).drop("_pos", "_neg")  # one row
