"""Longitudinal scores: subject slopes, feature slopes, their association and its robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import scalars
from cohortloom.functions.dist import normal_p_value, t_p_value
from cohortloom.operators import information, linmod, mixed, pca, ranks, replicates as replicated, resample, tables, visits
from cohortloom.storage import materialize


def feature_slopes(df: DataFrame, subject: str, feature: str, value: str, years: str) -> DataFrame:
    """Baseline value and slope over time of every (subject, feature)."""
    lines = visits.slopes(df, [subject, feature], value, years)
    first = df.groupBy(subject, feature).agg(F.min_by(value, F.struct(years, value)).alias("baseline"))
    return lines.join(first, [subject, feature]).select(
        subject, feature, "baseline", F.col("slope").alias("feature_slope"))


def slope_associations(slopes: DataFrame, feature: str, outcome: str, predictors: Sequence[str],
                       terms: Sequence[str] | None = None) -> DataFrame:
    """One model per feature, terms of interest with p adjusted within each term."""
    fits = linmod.fit_ols(slopes, [feature], outcome, predictors)
    kept = fits.where(F.col("term").isin(*(terms or predictors)))
    return ranks.adjust_fdr(kept, ["term"], "p_value", [feature], "p_fdr").withColumns({
        "low": scalars.wald_low(F.col("estimate"), F.col("std_error")),
        "high": scalars.wald_high(F.col("estimate"), F.col("std_error")),
        "significant": F.col("p_fdr") <= 0.05,
    })


def progression_association(series: DataFrame, measures: DataFrame, people: DataFrame, subject: str, score: str,
                            years: str, feature: str, value: str, carrier: str) -> dict[str, DataFrame]:
    """Score slopes from a mixed model against feature slopes.

    ``series``: subject, visit, years, score; ``measures``: subject, visit,
    feature, positive value; ``people``: one row per subject.
    """
    fit, table = mixed.fit_random_slope(series, subject, score, [years], years)
    deviations = mixed.predicted_deviations(fit, table)
    timed = measures.join(series.select(subject, "visit", years), [subject, "visit"])
    logged = timed.withColumn("_log", scalars.safe_log2(F.col(value))).where(F.col("_log").isNotNull())
    slopes = feature_slopes(logged, subject, feature, "_log", years)
    features = materialize(slopes.join(deviations, subject).join(people, subject), "features")
    both = features.withColumn("slope_x_carrier", F.col("slope_dev") * F.col(carrier))
    return {
        "features": features,
        "associations": slope_associations(features, feature, "feature_slope", ["slope_dev", carrier]),
        "interactions": slope_associations(both, feature, "feature_slope", ["slope_dev", carrier, "slope_x_carrier"],
                                           ["slope_x_carrier"]),
    }


def progression_score(features: DataFrame, subject: str, feature: str, chosen: Sequence[str], outcome: str,
                      covariates: Sequence[str]) -> dict[str, DataFrame]:
    """First component of the chosen feature slopes, against the score slope."""
    wide = tables.to_wide(features, [subject, outcome, *covariates], feature, "feature_slope", chosen)
    complete = wide.dropna(subset=list(chosen)).withColumn("_panel", F.array(*[F.col(f"`{c}`") for c in chosen]))
    complete = materialize(complete, "panel")
    scored = pca.project(pca.fit_components(complete, "_panel"), complete, "_panel")
    oriented = pca.orient_by_outcome(scored, "pc1", outcome).drop("_panel")
    test = linmod.correlation_test(oriented, [], "pc1", outcome)
    return {
        "scores": oriented,
        "correlation": test.withColumn("p_value", t_p_value(F.col("statistic"), F.col("df"))),
        "model": linmod.fit_ols(oriented, [], outcome, ["pc1", *covariates]),
    }


def robustness_checks(table: DataFrame, key: str, outcome: str, score: str, covariates: Sequence[str],
                      replicates: int = 2000, seed: int = 1) -> dict[str, DataFrame]:
    """Fast against slow tertiles, then bootstrap and permutation of both models.

    One formula serves the observed and the resampled fits of each model.
    Replicates whose logistic fit does not settle stay in the count ``n_all``.
    """
    xs = [score, *covariates]
    rows = materialize(table.select(key, outcome, *xs).dropna(), "robustness")
    limits = ranks.exact_quantiles(rows, [], outcome, {"_lower": 1 / 3, "_upper": 2 / 3})
    grouped = rows.crossJoin(F.broadcast(limits)).withColumn(  # one row
        "prog_group", scalars.tertile_group(F.col(outcome), F.col("_lower"), F.col("_upper"))).drop("_lower", "_upper")
    extremes = materialize(
        grouped.where("prog_group <> 'mid'").withColumn("fast", (F.col("prog_group") == "fast").cast("int")), "extremes")

    flat = linmod.centered(rows, [outcome, *xs])
    linear = lambda stats, by: linmod.solve_moments(stats, by, outcome, xs).where(F.col("term") == score)
    whole = flat.withColumn("w", F.lit(1))

    boot = linear(replicated.bootstrap_moments(flat, replicates, seed, [key], [outcome, *xs]), ["b"])
    boot_log = replicated.bootstrap_logistic(extremes, replicates, seed + 1, [key], "fast", xs).where(F.col("term") == score)
    shuffled = linear(replicated.permuted_moments(flat, replicates, seed + 2, [key], outcome, xs), ["b"])
    shuffled_log = replicated.permuted_logistic(extremes, replicates, seed + 3, [key], "fast", xs).where(F.col("term") == score)
    observed = linear(linmod.weighted_moments(whole, [], [outcome, *xs], "w"), [])
    observed_log = linmod.fit_logistic(extremes, [], "fast", xs)
    tag = lambda d, name: d.withColumn("check", F.lit(name))
    intervals = tag(resample.bootstrap_interval(boot, [], "estimate"), "linear").unionByName(
        tag(resample.bootstrap_interval(boot_log, [], "odds_ratio", null_value=1.0), "odds_ratio"))
    permutations = tag(resample.permutation_p(observed, shuffled, [], "estimate"), "linear").unionByName(
        tag(resample.permutation_p(observed_log.where(F.col("term") == score), shuffled_log, [], "estimate"), "logistic"))
    return {
        "groups": grouped, "logistic": observed_log.withColumn("p_value", normal_p_value(F.col("statistic"))),
        "intervals": intervals, "permutations": permutations,
        "spread": tables.five_numbers(extremes, ["prog_group"], score),
    }


def hit_frequency(features: DataFrame, subject: str, feature: str, outcome: str, predictor: str,
                  replicates: int = 1000, top: int = 3, seed: int = 5) -> DataFrame:
    """How often each feature is among the smallest p-values over bootstraps of the subjects."""
    centre = features.groupBy(feature).agg(F.avg(outcome).alias("_mo"), F.avg(predictor).alias("_mp"))
    flat = features.join(centre, feature).withColumns(
        {outcome: F.col(outcome) - F.col("_mo"), predictor: F.col(predictor) - F.col("_mp")})
    stats = replicated.bootstrap_moments(flat, replicates, seed, [subject], [outcome, predictor], [feature])
    fits = materialize(linmod.solve_moments(stats, [feature, "b"], outcome, [predictor]).where(F.col("term") == predictor), "hits")
    ranked = information.top_per_replicate(fits.where("p_value is not null"), "b", feature, "p_value", top, descending=False)
    return information.selection_frequency(ranked, feature, replicates)


def effect_stability(df: DataFrame, feature: str, value: str, y: str, visit: str, visit_numbers: Sequence[int]) -> dict[str, DataFrame]:
    """Class effects per visit, their agreement across visits and their drift."""
    effects = linmod.two_group_difference(df, [feature, visit], value, y).where(F.col("estimate").isNotNull())
    effects = materialize(effects.withColumn("p_value", t_p_value(F.col("statistic"), F.col("df"))), "effects")
    pairs = materialize(linmod.visit_correlations(effects, feature, visit, "estimate", visit_numbers), "pairs")
    middle = F.percentile("correlation", 0.5)  # one value per pair of visits
    consistency = tables.sign_consistency(effects, feature, "estimate")
    return {
        "effects": effects, "pairs": pairs,
        "overall": pairs.agg(F.avg("correlation").alias("mean_cor"), middle.alias("median_cor"),
                             F.min("correlation").alias("min_cor"), F.max("correlation").alias("max_cor")),
        "by_lag": pairs.groupBy("lag").agg(F.avg("correlation").alias("mean_cor"), middle.alias("median_cor"),
                                           F.count(F.lit(1)).alias("n_pairs")),
        "consistency": consistency,
        "consistent": consistency.agg(F.count(F.lit(1)).alias("n_features"), F.count_if("all_same").alias("n_all_same"),
                                      F.count_if("mostly_same").alias("n_mostly_same")),
        "drift": visits.slopes(tables.keep_repeated(effects, feature, 2, visit), [feature], "estimate", visit),
    }


def feature_stability(df: DataFrame, sample: str, feature: str, value: str, y: str, group: str, groups: Sequence[str],
                      labels: Sequence[str], n: int = 100, top_k: int = 100, seed: int = 1, rebin: bool = True) -> DataFrame:
    """Bootstrap stability of feature scores in three groups and where each feature matters."""
    parts = {g: df.where(F.col(group) == g) for g in groups}
    stability = {g: materialize(information.information_stability(d, sample, feature, value, y, n, top_k, seed, rebin=rebin),
                                "stability") for g, d in parts.items()}
    full = {g: information.mutual_information(d, [feature], value, y) for g, d in parts.items()}
    return information.compare_groups(stability, full, feature, labels)
