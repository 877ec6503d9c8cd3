"""Linear and logistic models fitted from moments.

Raw rows are reduced in the JVM to means and (co)variances per model, which
Spark merges map-side with its stable one-pass formulas.  Only those moment
rows (one per model) reach NumPy for the small solves.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortloom.functions import dist
from cohortloom.operators.ranks import adjust_fdr, exact_quantiles, number_rows, prefix_sums
from cohortloom.storage import materialize

INTERCEPT = "intercept"


# ---- moments -------------------------------------------------------------

def moments(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, means and population covariances of the complete rows of each group."""
    complete = df.dropna(subset=list(columns))
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.avg(c).alias(f"m_{c}") for c in columns]
    for a, b in itertools.combinations_with_replacement(columns, 2):
        moment = F.var_pop(a) if a == b else F.covar_pop(a, b)
        aggregates.append(moment.alias(f"c_{a}|{b}"))
    return complete.groupBy(*by).agg(*aggregates)


def weighted_moments(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                     weight: str) -> DataFrame:
    """The same for weighted rows.  Columns should be near zero mean already."""
    complete = df.dropna(subset=list(columns))
    w = F.col(weight)
    aggregates = [F.sum(w).cast("double").alias("n")]
    aggregates += [F.sum(w * F.col(c)).alias(f"s_{c}") for c in columns]
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    aggregates += [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}|{b}") for a, b in pairs]
    return moments_of_sums(complete.groupBy(*by).agg(*aggregates), by, columns)


def moments_of_sums(sums: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Moment rows from ``n`` and the weighted sums ``s_a`` and ``s_a|b`` of the columns and their products."""
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    n = F.col("n")
    means = [(F.col(f"s_{c}") / n).alias(f"m_{c}") for c in columns]
    centered = [
        (F.col(f"s_{a}|{b}") / n - F.col(f"s_{a}") * F.col(f"s_{b}") / n / n).alias(f"c_{a}|{b}")
        for a, b in pairs
    ]
    return sums.where(n > 0).select(*by, "n", *means, *centered)


def centered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the overall means (one broadcast row), for stable weighted sums."""
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(means))
    out = out.withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns})
    return out.drop(*[f"_mean_{c}" for c in columns])


#: A regressor is left out when those before it explain all but this share of its variance.
COLLINEAR = 1e-10


def _pivoted_inverse(corr: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of each correlation matrix over its independent columns, and which these are.

    The columns are swept in their order; one whose remaining variance is below
    ``COLLINEAR`` depends on those before it and is passed over, so only that term is
    lost.  Rows and columns of such a term are zero in the inverse.
    """
    rows, p, _ = corr.shape
    swept, kept = np.where(usable[:, None, None], corr, 0.0), np.zeros((rows, p), bool)
    for j in range(p):
        pivot = swept[:, j, j]
        take = usable & (pivot > COLLINEAR)
        kept[:, j] = take
        if not take.any():
            continue
        part, d = swept[take], pivot[take][:, None]
        row, column = part[:, j, :] / d, part[:, :, j].copy()
        part -= column[:, :, None] * row[:, None, :]
        part[:, j, :], part[:, :, j] = row, column / d
        part[:, j, j] = -1 / d[:, 0]
        swept[take] = part
    both = kept[:, :, None] & kept[:, None, :]
    return np.where(both, -swept, 0.0), kept


def _solve_batch(pdf: pd.DataFrame, y: str, xs: Sequence[str]):
    """Coefficients, standard errors, residual df, variance and r2 for a batch of moment rows."""
    names = [y, *xs]
    rows, p = len(pdf), len(xs)
    cov = np.empty((rows, p + 1, p + 1))
    for i, j in itertools.combinations_with_replacement(range(p + 1), 2):
        cov[:, i, j] = cov[:, j, i] = pdf[f"c_{names[i]}|{names[j]}"].to_numpy(float)
    mean = np.stack([pdf[f"m_{c}"].to_numpy(float) for c in names], axis=1)
    n = pdf["n"].to_numpy(float)
    sxx, sxy, syy = cov[:, 1:, 1:], cov[:, 1:, 0], cov[:, 0, 0]
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", sxx), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    corr = sxx / safe[:, :, None] / safe[:, None, :]
    usable = np.isfinite(cov).all(axis=(1, 2)) & (n >= 1)
    inverse, kept = _pivoted_inverse(corr, usable)
    inverse /= safe[:, :, None] * safe[:, None, :]
    rank = kept.sum(axis=1)
    usable &= n >= rank + 1
    beta = np.einsum("bij,bj->bi", inverse, np.where(usable[:, None], sxy, 0.0))
    dof = n - rank - 1
    rss = np.maximum(n * (syy - np.einsum("bi,bi->b", beta, sxy)), 0.0)
    sigma2 = rss / np.where(dof > 0, dof, np.nan)
    variance = np.einsum("bii->bi", inverse) / n[:, None]
    se = np.sqrt(sigma2[:, None] * variance)
    b0 = mean[:, 0] - np.einsum("bi,bi->b", beta, mean[:, 1:])
    spread0 = 1 / n + np.einsum("bi,bij,bj->b", mean[:, 1:], inverse, mean[:, 1:]) / n
    coef = np.column_stack([b0, np.where(kept, beta, np.nan)])
    errors = np.column_stack([np.sqrt(sigma2 * spread0), np.where(kept, se, np.nan)])
    coef[~usable], errors[~usable] = np.nan, np.nan
    unscaled = np.column_stack([spread0, np.where(kept, variance, np.nan)])
    with np.errstate(invalid="ignore", divide="ignore"):
        r2 = 1 - rss / (n * syy)
    return coef, errors, dof, sigma2, r2, unscaled, mean[:, 0]


_FIT = ("estimate", "std_error", "statistic", "df", "p_value", "sigma2", "r2", "n", "unscaled", "level")


def solve_moments(stats: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Term table of one least-squares model per moment row.

    A term that depends on those before it (a constant or collinear regressor)
    has a NULL estimate and counts for no degree of freedom; the others are
    fitted without it.  A model with too few rows has NULL estimates.
    ``unscaled`` is the estimate's variance over sigma2, ``level`` the mean of y.
    """
    fields = [stats.schema[c] for c in by]
    fields += [T.StructField("term", T.StringType())]
    fields += [T.StructField(c, T.DoubleType())
               for c in _FIT]
    terms = [INTERCEPT, *xs]
    by, xs = list(by), list(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            coef, se, dof, sigma2, r2, unscaled, level = _solve_batch(pdf, y, xs)
            width = len(terms)
            out = pdf[by].loc[pdf.index.repeat(width)].reset_index(drop=True)
            out["term"] = np.tile(terms, len(pdf))
            out["estimate"], out["std_error"] = coef.ravel(), se.ravel()
            with np.errstate(invalid="ignore", divide="ignore"):
                t = np.where(se > 0, coef / se, np.nan).ravel()
            out["statistic"], out["df"] = t, np.repeat(dof, width)
            p = np.full(t.shape, np.nan)
            ok = np.isfinite(t)
            p[ok] = dist.t_two_sided(t[ok], out["df"].to_numpy()[ok])
            out["p_value"] = p
            out["sigma2"], out["r2"] = np.repeat(sigma2, width), np.repeat(r2, width)
            out["n"] = np.repeat(pdf["n"].to_numpy(float), width)
            out["unscaled"], out["level"] = unscaled.ravel(), np.repeat(level, width)
            yield out

    solved = stats.mapInPandas(solve, T.StructType(fields))
    return solved.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in _FIT})


def fit_ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """One least-squares fit per group: (term, estimate, std_error, statistic, df, p_value, ...)."""
    return solve_moments(moments(df, by, [y, *xs]), by, y, xs)


# ---- closed forms kept in the JVM ----------------------------------------

def two_group_difference(df: DataFrame, by: Sequence[str], value: str, y: str) -> DataFrame:
    """Difference of class means with pooled standard error and t per group."""
    pos, neg = F.when(F.col(y) == 1, F.col(value)), F.when(F.col(y) == 0, F.col(value))
    parts = df.groupBy(*by).agg(
        F.count(pos).alias("n_pos"), F.count(neg).alias("n_neg"),
        F.avg(pos).alias("_mp"), F.avg(neg).alias("_mn"),
        F.var_pop(pos).alias("_vp"), F.var_pop(neg).alias("_vn"),
    )
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    dof = n_pos + n_neg - 2
    within = F.when(dof > 0, (n_pos * F.col("_vp") + n_neg * F.col("_vn")) / F.nullif(dof, F.lit(0)))
    spread = F.try_divide(F.lit(1.0), n_pos) + F.try_divide(F.lit(1.0), n_neg)
    return (
        parts.withColumn("estimate", F.col("_mp") - F.col("_mn"))
        .withColumn("std_error", F.sqrt(within * spread))
        .withColumn("statistic", F.try_divide("estimate", "std_error"))
        .withColumn("df", dof.cast("double"))
        .select(*by, "n_pos", "n_neg", "estimate", "std_error", "statistic", "df")
    )


def correlation_test(df: DataFrame, by: Sequence[str], x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Pearson correlation per group with t, degrees of freedom and Fisher interval."""
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_sxy"),
        F.var_pop(x).alias("_sxx"), F.var_pop(y).alias("_syy"),
    )
    r, n = F.col("r"), F.col("n")
    half = F.try_divide(F.lit(z), F.when(n > 3, F.sqrt(n - 3)))
    fisher = F.when(F.abs(r) < 1, F.atanh(r))
    return (
        parts.withColumn("r", F.try_divide("_sxy", F.sqrt(F.col("_sxx") * F.col("_syy"))))
        .withColumn("df", (n - 2).cast("double"))
        .withColumn("statistic", F.try_divide(r * F.sqrt(F.greatest(F.col("df"), F.lit(0.0))),
                                              F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))))
        .withColumn("ci_low", F.tanh(fisher - half))
        .withColumn("ci_high", F.tanh(fisher + half))
        .select(*by, "n", "r", "statistic", "df", "ci_low", "ci_high")
    )


def visit_correlations(effects: DataFrame, feature: str, visit: str, estimate: str,
                       visits: Sequence[int] | None = None) -> DataFrame:
    """Correlation of feature effects between every two visits, pairwise complete.

    ``visits`` restricts the visits; by default all that occur take part.  A
    feature's effects are one array, as long as it has visits, whose pairs of
    visits go straight into the built-in correlation, which merges map-side.
    """
    known = effects.where(F.col(estimate).isNotNull())
    if visits is not None:
        known = known.where(F.col(visit).isin(*visits))
    cells = known.groupBy(feature, visit).agg(F.max(estimate).alias("_value"))
    rows = cells.groupBy(feature).agg(F.array_sort(F.collect_list(F.struct(F.col(visit).cast("int").alias("v"), F.col("_value").alias("x")))).alias("_row"))
    later = lambda a, i: F.transform(
        F.slice("_row", i + 2, F.size("_row")),
        lambda b: F.struct(a["v"].alias("visit_1"), b["v"].alias("visit_2"), a["x"].alias("x"), b["x"].alias("y")))
    pairs = rows.select(F.inline(F.flatten(F.transform("_row", later))))
    total = pairs.groupBy("visit_1", "visit_2").agg(F.count(F.lit(1)).alias("n_features"), F.corr("x", "y").alias("_r"))
    return total.select(
        "visit_1", "visit_2", (F.col("visit_2") - F.col("visit_1")).alias("lag"), "n_features",
        F.when((F.col("n_features") >= 2) & ~F.isnan("_r"), F.col("_r")).alias("correlation"))


# ---- feature-wise fits with moderated variance ---------------------------

def fit_features(df: DataFrame, feature: str, value: str, xs: Sequence[str], term: str) -> DataFrame:
    """Per-feature fit on a shared design; one row per feature for one coefficient.

    Columns: coefficient, its unscaled variance, residual variance and df,
    mean level over the rows with all regressors.  All come from one scan.
    """
    fits = fit_ols(df, [feature], value, xs).where(F.col("term") == term)
    return fits.select(
        feature, F.col("estimate").alias("log_fc"), F.col("unscaled").alias("unscaled_var"), "sigma2", "df",
        F.col("level").alias("ave_expr"))


def variance_prior(fits: DataFrame) -> tuple[float, float]:
    """Prior degrees of freedom and variance (scaled F on log residual variances).

    One aggregate over per-feature variances; only its few scalars are solved
    on the driver.  Infinite prior df is returned when variances do not differ
    beyond sampling noise.
    """
    judged = fits.where((F.col("sigma2") >= 0) & (F.col("df") > 0))
    middle = exact_quantiles(judged, [], "sigma2", {"_median": 0.5}).first()
    # variances of zero count as a small share of the median
    floor = 1e-5 * (float(middle[0]) if middle is not None and middle[0] else 1.0)
    used = judged.withColumn("sigma2", F.greatest("sigma2", F.lit(floor)))
    by_df = used.groupBy("df").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.log("sigma2")).alias("m"),
        F.var_pop(F.log("sigma2")).alias("v"), F.avg("sigma2").alias("plain"),
    ).toPandas()  # one row per distinct residual df
    if by_df.empty:
        return float("nan"), float("nan")
    d, n = by_df["df"].to_numpy(float), by_df["n"].to_numpy(float)
    shift = dist.digamma(d / 2) - np.log(d / 2)
    e_mean_parts = by_df["m"].to_numpy(float) - shift
    mean = float(np.average(e_mean_parts, weights=n))
    plain = float(np.average(by_df["plain"].to_numpy(float), weights=n))
    total = float(n.sum())
    if total < 2:
        return float("inf"), plain
    spread = float((n * (by_df["v"].to_numpy(float) + (e_mean_parts - mean) ** 2)).sum() / (total - 1))
    excess = spread - float(np.average(dist.trigamma(d / 2), weights=n))
    if excess <= 0:  # the variances scatter no more than by chance: one common variance, their mean
        return float("inf"), plain
    d0 = 2.0 * dist.inverse_trigamma(excess)
    return d0, float(np.exp(mean + float(dist.digamma(np.array([d0 / 2]))[0]) - np.log(d0 / 2)))


def moderate(fits: DataFrame, d0: float, s0_squared: float) -> DataFrame:
    """Posterior variance and moderated t for a given prior.

    The degrees of freedom of t are those of the residuals and the prior, at
    most all residual degrees of freedom of the table together.  The fits are
    written once, as both the sum and the rows are read from them.
    """
    fits = materialize(fits, "feature-fits")
    pooled = fits.agg(F.sum("df").cast("double").alias("_pooled"))
    if np.isinf(d0):
        posterior, dof = F.lit(float(s0_squared)), F.col("_pooled")
    else:
        posterior = (d0 * s0_squared + F.col("df") * F.col("sigma2")) / (d0 + F.col("df"))
        dof = F.least(F.col("df") + d0, F.col("_pooled"))
    return fits.crossJoin(F.broadcast(pooled)).withColumns({  # one row
        "post_var": posterior,
        "total_df": dof,
    }).drop("_pooled").withColumn("t", F.try_divide("log_fc", F.sqrt(F.col("post_var") * F.col("unscaled_var"))))


def log_odds(table: DataFrame, t: str, total_df: str, unscaled: str, d_var: Column | float,
             share: float = 0.01) -> Column:
    """Log odds of a non-zero effect for a prior effect variance ``d_var`` (unscaled)."""
    v0 = F.lit(float(d_var)) if isinstance(d_var, float) else d_var
    ratio = (F.col(unscaled) + v0) / F.col(unscaled)
    t2 = F.pow(t, 2)
    kernel = (1 + F.col(total_df)) / 2 * F.log((t2 + F.col(total_df)) / (t2 / ratio + F.col(total_df)))
    return F.log(F.lit(share / (1 - share))) - F.log(ratio) / 2 + kernel


def effect_variance(table: DataFrame, feature: str, s0_squared: float, share: float = 0.01,
                    bounds: tuple[float, float] = (0.1, 4.0)) -> float:
    """Prior variance of true effects from the largest moderated t statistics.

    The top ``share/2`` of the statistics are compared with the normal scores
    expected for their rank, in units of each unscaled variance.  The share is at
    least that of the statistics looked at, and the result is held between the
    ``bounds``, squared, over the prior variance ``s0_squared``.  Ranks, scores and
    quantiles are columns; one mean comes back.
    """
    n = table.count()
    if not n:
        return float("nan")
    keep = max(1, int(np.ceil(n * share / 2)))
    share = max(share, keep / n)
    low, high = bounds[0] ** 2 / s0_squared, bounds[1] ** 2 / s0_squared
    sized = table.select(feature, F.abs("t").alias("_t"), "total_df", "unscaled_var").where(F.col("_t").isNotNull())
    ranked = number_rows(sized.withColumn("_down", -F.col("_t")), [], ["_down", feature], "_rank").where(F.col("_rank") <= keep)
    p0 = dist.t_p_value(F.col("_t"), F.col("total_df"))
    target = ((F.col("_rank") - 0.5) / n - (1 - share) * p0) / share
    scored = ranked.withColumns({"_p0": p0, "_target": target})
    quantile = dist.t_quantile(F.col("_target"), F.col("total_df"))
    own = F.greatest(F.lit(0.0), F.col("unscaled_var") * (F.pow(F.col("_t") / quantile, 2) - 1))
    held = F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.col("_target") > F.col("_p0"), own).otherwise(F.lit(0.0))))
    result = scored.select(held.alias("_v")).agg(F.avg("_v")).first()[0]
    return float(low if result is None else result)


def ranked_table(fits: DataFrame, feature: str, alpha: float = 0.05) -> DataFrame:
    """Moderated result table with adjusted p, log odds and volcano columns."""
    d0, s0 = variance_prior(fits)
    tested = moderate(fits, d0, s0).withColumn("p_value", dist.t_p_value(F.col("t"), F.col("total_df")))
    adjusted = adjust_fdr(tested, [], "p_value", [feature], "adj_p")
    v0 = effect_variance(tested, feature, s0)
    return adjusted.select(
        feature, "log_fc", "ave_expr", "t", "p_value", "adj_p",
        log_odds(adjusted, "t", "total_df", "unscaled_var", v0).alias("log_odds"),
        F.when(F.col("adj_p") > 0, -F.log10("adj_p")).alias("neg_log10_fdr"),
        (F.col("adj_p") < alpha).alias("significant"),
    )


# ---- logistic regression, many replicates in lock-step -------------------

def fit_logistic(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str],
                 weight: str | None = None, rounds: int = 100, tol: float = 1e-8,
                 z: float = 1.96) -> DataFrame:
    """Logistic fits for all groups together by iterated weighted least squares.

    Rows that are equal in a group are counted once, before the first round.  Each
    round is a single grouped aggregate over these counts, whatever the number
    of groups; the current coefficients (one small row per group) travel by
    join, and groups that have settled drop out.  Groups whose classes can be separated do not converge: ``converged`` is
    false and their figures are NULL.
    """
    by, xs = list(by), list(xs)
    terms = [INTERCEPT, *xs]
    p = len(terms)
    spark = df.sparkSession
    used = df.dropna(subset=[y, *xs])
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    # equal rows are counted first: replicates of a few regressors come down to a few rows each
    counted = used.groupBy(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate([y, *xs])]).agg(F.sum(w0).alias("_w"))
    base = materialize(counted.where("_w > 0").select(
        *by, F.col("_c0").alias("_y"), "_w", F.array(F.lit(1.0), *[F.col(f"_c{i + 1}") for i in range(p - 1)]).alias("_x")), "logistic-rows")
    key_fields = [base.schema[c] for c in by]
    state = base.select(*by).distinct() if by else spark.range(1).select()
    state = state.select(*by, F.array(*[F.lit(0.0)] * p).alias("_beta"), F.lit(float("inf")).alias("_step"))
    pairs = list(itertools.combinations_with_replacement(range(p), 2))
    schema = T.StructType([*key_fields, T.StructField("_beta", T.ArrayType(T.DoubleType())),
                           T.StructField("_step", T.DoubleType()),
                           T.StructField("_se", T.ArrayType(T.DoubleType())),
                           T.StructField("_n", T.DoubleType())])

    def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows = len(pdf)
            info = np.empty((rows, p, p))
            for i, j in pairs:
                info[:, i, j] = info[:, j, i] = pdf[f"h{i}_{j}"].to_numpy(float)
            grad = np.stack([pdf[f"g{i}"].to_numpy(float) for i in range(p)], axis=1)
            beta = np.stack(pdf["_beta"].to_numpy())
            step, se = np.full((rows, p), np.nan), np.full((rows, p), np.nan)
            for r in range(rows):
                try:
                    inverse = np.linalg.inv(info[r])
                except np.linalg.LinAlgError:
                    continue
                step[r], se[r] = inverse @ grad[r], np.sqrt(np.diag(inverse))
            moved = np.abs(step).max(axis=1) if rows else np.zeros(0)
            out = pdf[by].copy()
            out["_beta"], out["_step"] = list(beta + step), moved
            out["_se"], out["_n"] = list(se), pdf["_n"].to_numpy(float)
            yield out

    settled: list[DataFrame] = []
    for _ in range(rounds):
        # coefficients are a stored table of known size: Spark broadcasts it while it is small
        carried = state.select(*by, "_beta")
        rows = base.join(carried, by) if by else base.crossJoin(F.broadcast(carried))  # one row
        eta = sum((F.element_at("_x", i + 1) * F.element_at("_beta", i + 1) for i in range(p)), F.lit(0.0))
        rows = rows.withColumn("_mu", 1 / (1 + F.exp(-eta)))
        curve = F.col("_w") * F.col("_mu") * (1 - F.col("_mu"))
        x = lambda i: F.element_at("_x", i + 1)
        sums = [F.sum(curve * x(i) * x(j)).alias(f"h{i}_{j}") for i, j in pairs]
        sums += [F.sum(F.col("_w") * (F.col("_y") - F.col("_mu")) * x(i)).alias(f"g{i}") for i in range(p)]
        sums += [F.sum("_w").alias("_n"), F.first("_beta").alias("_beta")]
        after = materialize(rows.groupBy(*by).agg(*sums).mapInPandas(newton, schema), "logistic")
        running = (F.col("_step") > tol) & (F.col("_step") < 1e3)
        settled.append(after.where(~F.coalesce(running, F.lit(False))))  # a group that has settled takes no more part
        state = after.where(running)
        if not state.limit(1).count():
            break
    else:
        settled.append(state)
    return logistic_terms(functools.reduce(DataFrame.unionByName, settled), by, terms, tol, z)


def logistic_terms(state: DataFrame, by: Sequence[str], terms: Sequence[str], tol: float = 1e-8, z: float = 1.96) -> DataFrame:
    """Term table of logistic fits from their last round (``by``, ``_beta``, ``_step``, ``_se``, ``_n``)."""
    ok = F.coalesce(F.col("_step") <= tol, F.lit(False))  # a step that is no number has not settled either
    long = state.select(*by, "_step", "_n", F.posexplode(F.arrays_zip("_beta", "_se")).alias("_i", "_v"))
    long = long.select(*by, "_step", F.col("_n").alias("n"),
                       F.element_at(F.array(*map(F.lit, terms)), F.col("_i") + 1).alias("term"),
                       F.col("_v._beta").alias("estimate"), F.col("_v._se").alias("std_error"))
    tidy = long.select(
        *by, "n", "term", ok.alias("converged"), F.when(ok, F.col("estimate")).alias("estimate"),
        F.when(ok, F.col("std_error")).alias("std_error"),
    )
    z_stat = F.try_divide("estimate", "std_error")
    return tidy.withColumns({
        "statistic": z_stat,
        "p_value": dist.normal_p_value(z_stat),
        "odds_ratio": F.exp("estimate"),
        "or_low": F.exp(F.col("estimate") - z * F.col("std_error")),
        "or_high": F.exp(F.col("estimate") + z * F.col("std_error")),
    })


# ---- tests between groups ------------------------------------------------

def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square statistic and df of a two-way table (no continuity correction)."""
    cells = df.dropna(subset=[row, column]).groupBy(row, column).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(row).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # sum (o - e)^2 / e over all cells = n * (sum o^2 / (r c) - 1): empty cells need no row
    joined = cells.join(rows, row).join(cols, column)
    stat = joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"))
    shape = rows.agg(F.count(F.lit(1)).alias("nr")).crossJoin(cols.agg(F.count(F.lit(1)).alias("nc")))
    return stat.crossJoin(total).crossJoin(shape).select(
        (F.col("n") * (F.col("s") - 1)).alias("statistic"),
        ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("long").alias("df"),
    )


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis statistic with tie correction, from per-value counts."""
    used = df.dropna(subset=[value, group])
    counts = used.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(counts, [], [value], {"before": "c"}, totals=True)
    ranked = ranked.withColumn("mid", F.col("before") + (F.col("c") + 1) / 2.0)
    by_group = used.groupBy(value, group).agg(F.count(F.lit(1)).alias("k"))
    sums = by_group.join(ranked, value).groupBy(group).agg(
        F.sum(F.col("k") * F.col("mid")).alias("r"), F.sum("k").alias("k")
    )
    total = ranked.agg(F.sum("c").alias("n"),
                       F.sum(F.pow("c", 3) - F.col("c")).alias("ties"))
    spread = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"),
                      (F.count(F.lit(1)) - 1).alias("df"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return spread.crossJoin(total).select(
        F.try_divide(h, 1 - F.col("ties") / (F.pow(n, 3) - n)).alias("statistic"), "df"
    )
