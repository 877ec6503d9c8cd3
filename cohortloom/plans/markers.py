"""Marker discovery and transfer: score features, train a classifier, test it elsewhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.operators import classify, information, normalize, pca, resample, tables
from cohortloom.operators.linmod import fit_ols, ranked_table, fit_features
from cohortloom.operators.mixed import fit_random_intercept
from cohortloom.operators.ranks import rank_auc
from cohortloom.storage import materialize


def marker_table(df: DataFrame, feature: str, value: str, y: str, names: DataFrame | None = None,
                 above: float = 0.0) -> DataFrame:
    """Features with information about the class: (feature, name, direction, importance)."""
    gains = information.information_gain(df, feature, value, y).where(F.col("importance") > above)
    means = tables.class_means(df, feature, value, y).select(feature, "direction")
    out = gains.join(means, feature)
    out = out.join(names, feature, "left") if names is not None else out.withColumn("name", F.lit(None).cast("string"))
    return out.select(feature, "name", "direction", "importance")


def sample_vectors(df: DataFrame, sample: str, feature: str, value: str, y: str, panel: DataFrame) -> DataFrame:
    """One row per sample with the panel's values in feature order."""
    kept = df.join(panel.select(feature), feature, "left_semi")
    return tables.assemble(kept, [sample, y], feature, value, panel=panel)


def evaluate(model, df: DataFrame, key: str, y: str, group: str) -> DataFrame:
    """Confusion metrics and AUC of a fitted model on one held-out group (one row)."""
    scored = materialize(classify.score(model, classify.with_vector(df), [key, y]), "scored").withColumn("grp", F.lit(group))
    metrics = classify.confusion(scored, ["grp"], y, "predicted")
    return metrics.join(rank_auc(scored, ["grp"], "prob", y).select("grp", "auc"), "grp")


def train_and_test(train: DataFrame, tests: Mapping[str, DataFrame], key: str, y: str, panel: Sequence[str],
                   grid: Sequence[str] = ("sqrt", "log2", "onethird"), folds: int = 5, repeats: int = 5,
                   n_trees: int = 100, seed: int = 42, balance: Sequence[str] = ("smote", "up")) -> dict[str, DataFrame]:
    """Tune by cross-validation, fit on all training rows, test on each held-out group."""
    spark = train.sparkSession
    scores = materialize(
        classify.cross_validate(train, key, y, grid, folds, repeats, n_trees, seed, balance), "fold-scores")
    tuning = classify.tune(scores, y)
    best = tuning.first()
    final = materialize(classify.balanced(train, key, y, balance, seed), "final-train")
    fitted = classify.forest(n_trees, best.setting, seed=seed, label=y).fit(classify.with_vector(final))
    metrics = None
    for group, df in tests.items():
        one = evaluate(fitted, df, key, y, group)
        metrics = one if metrics is None else metrics.unionByName(one)
    metrics = metrics.withColumns({"cv_auc_mean": F.lit(best.auc_mean), "cv_auc_sd": F.lit(best.auc_sd)})
    importance = classify.scale_0_100(classify.importance_table(fitted, panel, spark), "raw", "importance")
    return {"metrics": metrics, "tuning": tuning, "importance": importance}


def transfer_classifier(df: DataFrame, sample: str, feature: str, value: str, y: str, group: str, train_group: str,
                        test_groups: Sequence[str], **settings) -> dict[str, DataFrame]:
    """Find markers and train in one group, test in the others."""
    home = df.where(F.col(group) == train_group)
    markers = materialize(marker_table(home, feature, value, y), "markers")
    panel = [r[0] for r in markers.select(feature).orderBy(feature).collect()]  # the chosen markers
    vectors = lambda d: sample_vectors(d, sample, feature, value, y, markers)
    tests = {g: vectors(df.where(F.col(group) == g)) for g in test_groups}
    out = train_and_test(materialize(vectors(home), "train"), tests, sample, y, panel, **settings)
    return {"markers": markers, **out}


def omics_differential(df: DataFrame, sample: str, feature: str, value: str, samples: DataFrame, y: str,
                       batch: str, design: Sequence[str], kind: str = "counts",
                       adjust_values: bool = True) -> DataFrame:
    """Differential features of a count (``counts``) or intensity (``intensity``) matrix.

    Quality filter, normalisation, then a moderated model of the class with the
    design columns.  Batches are either removed from the values beforehand or
    (``adjust_values=False``) put into the model.
    """
    prepared, batch_columns = prepare_matrix(df, sample, feature, value, samples, batch, design, kind)
    if adjust_values:
        fits = fit_features(prepared, feature, "adjusted", [y, *design], y)
    else:
        fits = fit_features(prepared, feature, "level", [y, *design, *batch_columns], y)
    return ranked_table(fits, feature)


def prepare_matrix(df: DataFrame, sample: str, feature: str, value: str, samples: DataFrame, batch: str,
                   design: Sequence[str], kind: str) -> tuple[DataFrame, list[str]]:
    """Filtered, normalised and batch-adjusted long matrix joined with its samples."""
    n = samples.count()
    # every pass of the filter and of the normalisation reads the matrix
    present = materialize(df.join(samples.select(sample), sample, "left_semi"), "matrix")
    kept = tables.passing_features(tables.feature_quality(present, feature, value, n)).select(feature)
    filtered = present.join(kept, feature, "left_semi").select(sample, feature, value)
    if kind == "counts":
        level = normalize.variance_stabilize(filtered, sample, feature, value, "level")
    else:
        whole = tables.complete_grid(filtered, sample, feature, value, samples, kept)
        level = normalize.log2_with_offset(whole, value, "level", normalize.log_offset(present, value))
    levels = [r[0] for r in samples.select(batch).distinct().orderBy(batch).collect()]  # batches of the study
    coded = level.join(samples, sample).withColumns(tables.sum_contrasts(batch, levels, "batch_"))
    batch_columns = [f"batch_{i}" for i in range(1, len(levels))]
    return materialize(normalize.remove_batch(coded, feature, "level", design, batch_columns), "levels"), batch_columns


def omics_classifier(prepared: DataFrame, sample: str, feature: str, y: str, above: float = 0.0,
                     share: float = 0.7, seed: int = 42, **settings) -> dict[str, DataFrame]:
    """Stratified split, markers from the training part only, classifier tested on the rest."""
    people = prepared.select(sample, y).distinct()
    split = materialize(resample.stratified_split(people, y, [sample], share, seed).select(sample, "is_train"), "split")
    rows = prepared.join(split, sample)
    train = rows.where("is_train = 1")
    markers = materialize(marker_table(train, feature, "adjusted", y, above=above), "markers")
    panel = [r[0] for r in markers.select(feature).orderBy(feature).collect()]  # the chosen markers
    if not panel:
        raise ValueError("no feature carries information about the class")
    vectors = lambda d: sample_vectors(d, sample, feature, "adjusted", y, markers)
    test = vectors(rows.where("is_train = 0"))
    return {"markers": markers, **train_and_test(materialize(vectors(train), "train"), {"test": test}, sample, y, panel, **settings)}


def marker_score_by_group(df: DataFrame, key: str, array: str, y: str, group: str, groups: Sequence[str],
                          covariates: Sequence[str]) -> dict[str, DataFrame]:
    """First component within each group, carriers against the rest, adjusted model per group."""
    parts = None
    for g in groups:
        rows = df.where(F.col(group) == g)
        scored = pca.orient_by_group(pca.project(pca.fit_components(rows, array), rows, array), "pc1", y)
        part = scored.select(key, F.lit(g).alias("grp"), "pc1", y, *covariates)
        parts = part if parts is None else parts.unionByName(part)
    models = fit_ols(parts, ["grp"], "pc1", [y, *covariates])
    return {"scores": parts, "models": models, "summary": tables.five_numbers(parts, ["grp", y], "pc1")}


def score_over_time(df: DataFrame, subject: str, array: str, years: str, y: str):
    """Mixed model of the marker score by time, class and their interaction."""
    scored = pca.orient_by_group(pca.project(pca.fit_components(df, array), df, array), "pc1", y)
    rows = scored.withColumn("years_x_class", F.col(years) * F.col(y))
    fit, _ = fit_random_intercept(rows, subject, "pc1", [years, y, "years_x_class"])
    return fit


def auc_by_band(df: DataFrame, scores: DataFrame, sample: str, feature: str, value: str, y: str,
                score_name: str = "mi", **settings) -> DataFrame:
    """Cross-validated AUC of a classifier built on the features of each score band.

    ``scores`` is (feature, score).  The loop runs over the seven fixed bands.
    """
    banded = materialize(scores.withColumn("band", classify.score_band(F.col(score_name))).select(feature, "band"), "bands")
    sizes = banded.where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n_features")).collect()
    out = None
    for row in sizes:
        panel = banded.where(F.col("band") == row.band)
        vectors = materialize(sample_vectors(df, sample, feature, value, y, panel), "band-vectors")
        held = classify.cross_validate(vectors, sample, y, **settings)
        one = rank_auc(materialize(held, "band-scores"), ["repeat", "fold"], "prob", y)
        line = classify.auc_summary(one).select(
            F.lit(row.band).alias("band"), F.lit(row.n_features).alias("n_features"), "auc_mean", "auc_sd")
        out = line if out is None else out.unionByName(line)
    return out
