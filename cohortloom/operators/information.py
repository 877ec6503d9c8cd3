"""Feature scoring by information about a 0/1 class, for all features at once."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortloom.functions import draws
from cohortloom.functions.scalars import specificity_category
from cohortloom.operators.ranks import exact_quantiles, number_rows, prefix_sums
from cohortloom.operators.replicates import bootstrap_bins
from cohortloom.storage import materialize

LN2 = math.log(2.0)


def entropy(pos: Column, neg: Column) -> Column:
    """Entropy in nats of two class counts (0 for a pure or empty set)."""
    total = (pos + neg).cast("double")

    def term(count: Column) -> Column:
        share = count / total
        return F.when(count > 0, -share * F.log(share)).otherwise(F.lit(0.0))

    return F.when(total > 0, term(pos) + term(neg)).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, by: Sequence[str], value: str, y: str, weight: str | None = None) -> DataFrame:
    """Weighted class counts per distinct value: what every score here starts from."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    used = df.where(F.col(value).isNotNull() & F.col(y).isNotNull())
    return used.groupBy(*by, value).agg(
        F.sum(w * F.col(y).cast("long")).alias("pos"), F.sum(w * (1 - F.col(y).cast("long"))).alias("neg")
    )


# ---- entropy / description-length discretisation ---------------------------

def _cut_table(active: DataFrame, feature: str, value: str) -> DataFrame:
    """Best cut of every open interval with its gain and acceptance test (nats)."""
    left_p, left_n = F.col("p") - F.col("lo_p"), F.col("n") - F.col("lo_n")
    size = (F.col("tot_p") + F.col("tot_n")).cast("double")
    right_p, right_n = F.col("tot_p") - left_p, F.col("tot_n") - left_n
    inside = active.where(left_p + left_n < F.col("tot_p") + F.col("tot_n"))
    after = ((left_p + left_n) * entropy(left_p, left_n) + (right_p + right_n) * entropy(right_p, right_n)) / size
    scored = inside.select(
        feature, "lo_p", "lo_n", "tot_p", "tot_n", F.col(value).alias("cut"),
        left_p.alias("left_p"), left_n.alias("left_n"), F.round(after, 12).alias("after"),
    )
    best = scored.groupBy(feature, "lo_p", "lo_n").agg(
        F.min_by(F.struct("cut", "left_p", "left_n", "tot_p", "tot_n", "after"),
                 F.struct("after", "cut")).alias("_b")
    ).select(feature, "lo_p", "lo_n", "_b.*")
    right_p, right_n = F.col("tot_p") - F.col("left_p"), F.col("tot_n") - F.col("left_n")
    whole = entropy(F.col("tot_p"), F.col("tot_n"))
    ent_l, ent_r = entropy(F.col("left_p"), F.col("left_n")), entropy(right_p, right_n)
    classes = lambda p, n: (p > 0).cast("int") + (n > 0).cast("int")
    k, k_l, k_r = (classes(F.col("tot_p"), F.col("tot_n")), classes(F.col("left_p"), F.col("left_n")),
                   classes(right_p, right_n))
    delta = F.log(F.pow(F.lit(3.0), k) - 2) - (k * whole - k_l * ent_l - k_r * ent_r)
    gain = whole - F.col("after")
    accepted = gain > (F.log(size - 1) + delta) / size
    return best.withColumns({"size": size, "gain": gain, "accepted": accepted & (size > 1)})


def _cumulative(df: DataFrame, feature: str, value: str, y: str) -> DataFrame:
    counts = class_counts(df, [feature], value, y)
    ranked = prefix_sums(counts, [feature], [value], {"_p": "pos", "_n": "neg"}, totals=True)
    zero = F.lit(0).cast("long")
    return ranked.select(
        feature, value, (F.col("_p") + F.col("pos")).alias("p"), (F.col("_n") + F.col("neg")).alias("n"),
        zero.alias("lo_p"), zero.alias("lo_n"),
        F.col("_p_total").alias("tot_p"), F.col("_n_total").alias("tot_n"),
    )


def first_cut(df: DataFrame, feature: str, value: str, y: str) -> DataFrame:
    """Best binary cut of every feature with the description-length test."""
    cuts = _cut_table(_cumulative(df, feature, value, y), feature, value)
    return cuts.select(feature, "cut", "gain", "accepted")


def accepted_cuts(df: DataFrame, feature: str, value: str, y: str) -> DataFrame:
    """All cuts accepted by recursive splitting: (feature, cut, size, gain).

    Values are counted and accumulated once.  Every round then scores all open
    intervals of all features with one grouped aggregate; an interval is known
    by the cumulative counts at its start.  Rounds go on until nothing splits.
    """
    active = materialize(_cumulative(df, feature, value, y), "cut-candidates")
    found = []
    while True:
        split = materialize(_cut_table(active, feature, value).where("accepted"), "cuts")
        if split.limit(1).count() == 0:
            break
        found.append(split.select(feature, "cut", "size", "gain"))
        cut = split.select(feature, "lo_p", "lo_n", "cut", "left_p", "left_n")
        joined = active.join(cut, [feature, "lo_p", "lo_n"])
        left = F.col(value) <= F.col("cut")
        active = materialize(joined.select(
            feature, value, "p", "n",
            F.when(left, F.col("lo_p")).otherwise(F.col("lo_p") + F.col("left_p")).alias("lo_p"),
            F.when(left, F.col("lo_n")).otherwise(F.col("lo_n") + F.col("left_n")).alias("lo_n"),
            F.when(left, F.col("left_p")).otherwise(F.col("tot_p") - F.col("left_p")).alias("tot_p"),
            F.when(left, F.col("left_n")).otherwise(F.col("tot_n") - F.col("left_n")).alias("tot_n"),
        ), "cut-candidates")
    if not found:
        return split.select(feature, "cut", "size", "gain")
    return functools.reduce(DataFrame.unionByName, found)


def information_gain(df: DataFrame, feature: str, value: str, y: str, base: float = math.e) -> DataFrame:
    """Information gain of every feature after discretisation; 0 without an accepted cut.

    The gain of the whole partition is the size-weighted sum of its splits' gains.
    """
    cuts = accepted_cuts(df, feature, value, y)
    totals = df.where(F.col(value).isNotNull() & F.col(y).isNotNull()).groupBy(feature).agg(
        F.count(F.lit(1)).alias("_all"))
    gains = cuts.groupBy(feature).agg(F.sum(F.col("size") * F.col("gain")).alias("_gain"))
    share = F.coalesce(F.col("_gain") / F.col("_all"), F.lit(0.0)) / F.lit(math.log(base))
    return totals.join(gains, feature, "left").select(feature, share.alias("importance"))


# ---- equal-frequency bins and mutual information -----------------------------

def bin_of(before: Column, total: Column, bins: int) -> Column:
    """Equal-frequency bin (from 1) of a value with ``before`` smaller ones out of ``total``.

    Equal values share a bin.
    """
    return (F.floor(before * F.lit(bins) / total) + 1).cast("int")


def equal_frequency_bins(df: DataFrame, by: Sequence[str], value: str, bins: int = 5) -> DataFrame:
    """Bin of every distinct value per group: (by, value, n, bin)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, by, [value], {"_before": "n"}, totals=True)
    return ranked.select(*by, value, "n", bin_of(F.col("_before"), F.col("_before_total"), bins).alias("bin"))


def _information(contingency: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mutual information in nats from (by, bin, pos, neg, all_pos, all_neg)."""
    total = (F.col("all_pos") + F.col("all_neg")).cast("double")
    in_bin = F.col("pos") + F.col("neg")

    def part(count: Column, margin: Column) -> Column:
        ratio = count * total / (in_bin * margin.cast("double"))
        return F.when(count > 0, count / total * F.log(ratio)).otherwise(F.lit(0.0))

    value = part(F.col("pos"), F.col("all_pos")) + part(F.col("neg"), F.col("all_neg"))
    return contingency.groupBy(*by).agg(F.sum(value).alias("mi"))


def mutual_information(df: DataFrame, by: Sequence[str], value: str, y: str, bins: int = 5,
                       weight: str | None = None, small_groups: bool = False) -> DataFrame:
    """Mutual information (nats) of the binned value and the class, per group."""
    by = list(by)
    counts = class_counts(df, by, value, y, weight)
    ranked = prefix_sums(counts, by, [value], {"_p": "pos", "_n": "neg"}, totals=True, small_groups=small_groups)
    binned = ranked.withColumn(
        "bin", bin_of(F.col("_p") + F.col("_n"), F.col("_p_total") + F.col("_n_total"), bins)
    )
    contingency = binned.groupBy(*by, "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.max("_p_total").alias("all_pos"), F.max("_n_total").alias("all_neg"),
    )
    return _information(contingency, by)


def _replicate_blocks(df: DataFrame, n: int, seed: int, sample: str) -> DataFrame:
    blocks = -(-n // draws.DRAWS_PER_DIGEST)
    rows = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumn("_digest", draws.digest(seed, F.col("_block"), F.col(sample)))


def _expand_slots(df: DataFrame, n: int, keep: Sequence[str]) -> DataFrame:
    rows = df.select(*keep, "_block", F.posexplode(draws.words(F.col("_digest"))).alias("_slot", "_word"))
    rows = rows.withColumn("w", draws.poisson_weight(F.col("_word"))).drop("_word")
    rows = rows.withColumn("b", F.col("_block") * draws.DRAWS_PER_DIGEST + F.col("_slot"))
    return rows.where((F.col("w") > 0) & (F.col("b") < n)).drop("_slot")


def resampled_information(df: DataFrame, sample: str, feature: str, value: str, y: str, n: int,
                          seed: int, bins: int = 5, rebin: bool = True) -> DataFrame:
    """Mutual information of every feature in every Poisson bootstrap of the samples.

    ``rebin=True`` cuts the bins anew in each resample: rows are shuffled and sorted
    once, and a task holds the weights of all resamples as arrays.  With
    ``rebin=False`` bins are cut once and the expansion is reduced map-side to
    bin counts.
    """
    if rebin:
        counts = bootstrap_bins(df, n, seed, sample, feature, value, y, bins)
        group = W.partitionBy(feature, "b")
        margins = {f"all_{c}": F.sum(c).over(group) for c in ("pos", "neg")}
        return _information(counts.withColumns(margins), [feature, "b"])
    binned = equal_frequency_bins(df, [feature], value, bins).select(feature, value, "bin")
    rows = df.select(sample, feature, value, y).join(binned, [feature, value])
    spread = _expand_slots(_replicate_blocks(rows, n, seed, sample), n, [feature, "bin", y])
    w, label = F.col("w").cast("long"), F.col(y).cast("long")
    counts = spread.groupBy(feature, "b", "bin").agg(
        F.sum(w * label).alias("pos"), F.sum(w * (1 - label)).alias("neg"))
    margins = counts.groupBy(feature, "b").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return _information(counts.join(margins, [feature, "b"]), [feature, "b"])


def top_per_replicate(scores: DataFrame, replicate: str, feature: str, score: str, k: int,
                      descending: bool = True) -> DataFrame:
    """Flag the k best features of every replicate (ties by feature)."""
    order = -F.col(score) if descending else F.col(score)
    ranked = number_rows(scores.withColumn("_order", order), [replicate], ["_order", feature], "_rank")
    return ranked.withColumn("selected", (F.col("_rank") <= k).cast("int")).drop("_order", "_rank")


def selection_frequency(flagged: DataFrame, feature: str, n: int | None = None) -> DataFrame:
    """Share of replicates that select a feature."""
    share = F.avg(F.col("selected").cast("double")) if n is None else F.sum("selected") / F.lit(float(n))
    return flagged.groupBy(feature).agg(share.alias("sel_freq"))


def information_stability(df: DataFrame, sample: str, feature: str, value: str, y: str, n: int = 100,
                          top_k: int = 100, seed: int = 1, bins: int = 5, rebin: bool = True) -> DataFrame:
    """Median, mean, SD and selection frequency of the score over resamples."""
    scores = materialize(resampled_information(df, sample, feature, value, y, n, seed, bins, rebin), "scores")
    flagged = top_per_replicate(scores, "b", feature, "mi", top_k)
    return flagged.groupBy(feature).agg(
        F.percentile("mi", 0.5).alias("mi_median"),  # one value per replicate
        F.avg("mi").alias("mi_mean"), F.stddev_samp("mi").alias("mi_sd"),
        (F.sum("selected") / F.lit(float(n))).alias("sel_freq"),  # of all resamples, also those without the feature
    )


def compare_groups(stability: Mapping[str, DataFrame], full: Mapping[str, DataFrame], feature: str,
                   names: Sequence[str], quantile: float = 0.8, min_frequency: float = 0.8) -> DataFrame:
    """Join stability tables of three groups and tag where a feature matters.

    ``names`` are the five labels of :func:`specificity_category`.  A feature
    is high in a group when its median reaches the group's own quantile and it
    is selected often enough.
    """
    groups = list(stability)
    joined = None
    for g in groups:
        part = stability[g].select(feature, F.col("mi_median").alias(f"mi_median_{g}"),
                                   F.col("sel_freq").alias(f"sel_freq_{g}"))
        joined = part if joined is None else joined.join(part, feature, "full")
    for g in groups:
        joined = joined.join(full[g].select(feature, F.col("mi").alias(f"mi_full_{g}")), feature, "left")
    for g in groups:
        limit = exact_quantiles(stability[g], [], "mi_median", {f"_limit_{g}": quantile})
        joined = joined.crossJoin(F.broadcast(limit))  # one row
    high = {
        g: F.coalesce((F.col(f"mi_median_{g}") >= F.col(f"_limit_{g}"))
                      & (F.col(f"sel_freq_{g}") >= min_frequency), F.lit(False))
        for g in groups
    }
    first, second, third = groups
    delta = lambda c: F.col(f"{c}_{second}") - F.col(f"{c}_{first}") - F.col(f"{c}_{third}")
    return joined.withColumns({
        "delta_mi_median": delta("mi_median"), "delta_sel_freq": delta("sel_freq"),
        **{f"high_{g}": flag for g, flag in high.items()},
        "category": specificity_category(*[high[g] for g in groups], names),
    }).drop(*[f"_limit_{g}" for g in groups])
