"""Empirical-Bayes failure rates: beta-binomial shrinkage of groups towards a parent.

A group with ``n`` judged rows and ``f`` failures has prior mean ``prior``
(its parent's posterior mean).  One prior strength is estimated per level from
the scatter of the groups around their priors (method of moments):

    rho = (sum n (f/n - prior)^2 - sum prior (1 - prior)) / sum n prior (1 - prior)
    strength = (1 - rho) / rho, with rho held in [1e-6, 0.999]

The posterior is Beta(f + strength * prior, n - f + strength * (1 - prior)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RHO_LOW, RHO_HIGH = 1e-6, 0.999


def shrink(groups: DataFrame, prior: str, n: str = "n", f: str = "f",
           mean: str = "mean", size: str = "weight") -> DataFrame:
    """Add the posterior mean and the posterior's pseudo-count of each group.

    Groups with n = 0 take their prior mean.  The level's strength is a one-row
    aggregate, so the cross join adds one row to every group.
    """
    p, rows, bad = F.col(prior), F.col(n).cast("double"), F.col(f).cast("double")
    noise = p * (1 - p)
    level = groups.where(F.col(n) > 0).agg(
        F.sum(rows * (bad / rows - p) * (bad / rows - p)).alias("_scatter"),
        F.sum(noise).alias("_noise"), F.sum(rows * noise).alias("_scale"),
    )
    raw = F.when(F.col("_scale") > 0, (F.col("_scatter") - F.col("_noise")) / F.col("_scale"))
    rho = F.least(F.lit(RHO_HIGH), F.greatest(F.lit(RHO_LOW), F.coalesce(raw, F.lit(0.0))))
    level = level.select(((1 - rho) / rho).alias("_strength"))
    return (
        groups.crossJoin(F.broadcast(level))
        .withColumn(size, rows + F.col("_strength"))
        .withColumn(mean, (bad + F.col("_strength") * p) / F.col(size))
        .drop("_strength")
    )


def lower_bound(mean: str, size: str, z: float):
    """Lower posterior bound of the rate: mean less z posterior standard deviations."""
    m = F.col(mean)
    return m - F.lit(z) * F.sqrt(m * (1 - m) / (F.col(size) + 1))
