"""Bootstrap, permutation, splits and class balancing as DataFrame operations.

A resample is a value of a grouping column, never a loop over jobs: all
replicates are reduced by the same grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import draws
from cohortloom.operators.neighbours import exact_neighbours
from cohortloom.operators.ranks import number_rows
from cohortloom.storage import materialize

_BROADCAST_OUTCOMES = 1_000_000


def _blocks(n: int) -> int:
    return -(-n // draws.DRAWS_PER_DIGEST)


def bootstrap_rows(df: DataFrame, n: int, seed: int, key: Sequence[str],
                   replicate: str = "b", weight: str = "w") -> DataFrame:
    """Poisson(1) bootstrap: every row once per replicate in which its weight is > 0.

    The expansion is a narrow step; callers reduce it by ``groupBy(replicate)``
    map-side.  The size of a resample varies around the number of rows.
    """
    keys = [F.col(k) for k in key]
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(_blocks(n) - 1))))
    hashed = blocks.withColumn("_digest", draws.digest(seed, F.col("_block"), *keys))
    rows = hashed.select(*df.columns, "_block", F.posexplode(draws.words(F.col("_digest"))).alias("_slot", "_word"))
    rows = rows.withColumn(weight, draws.poisson_weight(F.col("_word"))).drop("_word")
    rows = rows.withColumn(replicate, F.col("_block") * draws.DRAWS_PER_DIGEST + F.col("_slot"))
    return rows.where((F.col(weight) > 0) & (F.col(replicate) < n)).drop("_block", "_slot")


def permuted_outcome(df: DataFrame, n: int, seed: int, key: Sequence[str], outcome: str,
                     replicate: str = "b") -> DataFrame:
    """Every row n times, each replicate with the outcome shuffled among the rows.

    The rows are numbered once, by key.  In every replicate the row at a place
    takes the outcome of the row at the place to which the replicate's keyed
    bijection sends it, so the rows times n are neither sorted nor numbered; the
    outcomes by place are broadcast if they were counted to be few, and joined
    by a hash of the place beyond.
    """
    numbered = materialize(number_rows(df, [], list(key), "_position"), "permutation-rows")
    total = numbered.count()
    source = numbered.select((F.col("_position") - 1).alias("_from"), F.col(outcome))
    source = F.broadcast(source) if total <= _BROADCAST_OUTCOMES else source.hint("shuffle_hash")
    spark = df.sparkSession
    replicates = spark.range(n).select(F.col("id").cast("int").alias(replicate)).withColumn("_keys", draws.round_keys(seed, F.col(replicate)))
    copies = numbered.drop(outcome).crossJoin(F.broadcast(replicates))  # n rows, a parameter
    sent = draws.permute(copies.withColumn("_position", F.col("_position") - 1), "_position", "_keys", max(total, 1), "_from")
    return sent.drop("_keys", "_position").join(source, "_from").drop("_from")


def stratified_split(df: DataFrame, stratum: str, key: Sequence[str], share: float, seed: int,
                     out: str = "is_train") -> DataFrame:
    """Flag ceil(share * n) rows of each stratum as training rows."""
    hashed = df.withColumn("_order", draws.digest(seed, F.lit(0), *[F.col(k) for k in key]))
    ranked = number_rows(hashed, [stratum], ["_order", *key], "_position", total="_size")
    return ranked.withColumn(
        out, (F.col("_position") <= F.ceil(F.lit(share) * F.col("_size"))).cast("int")
    ).drop("_order", "_position", "_size")


def stratified_folds(df: DataFrame, stratum: str, key: Sequence[str], folds: int, repeats: int,
                     seed: int) -> DataFrame:
    """Repeated stratified k-fold: one row per (repeat, row) with its ``fold``."""
    copies = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = copies.withColumn("_order", draws.digest(seed, F.col("repeat"), *[F.col(k) for k in key]))
    ranked = number_rows(hashed, ["repeat", stratum], ["_order", *key], "_position")
    fold = F.pmod(F.col("_position") - 1, F.lit(folds)).cast("int")
    return ranked.withColumn("fold", fold).drop("_order", "_position")


def upsample(df: DataFrame, by: Sequence[str], label: str, key: Sequence[str], seed: int,
             out: str = "copy") -> DataFrame:
    """Repeat rows of smaller classes until every class is as large as the largest.

    Copies are spread evenly: all rows get the whole quotient, and a hashed
    choice of rows gets the remainder.
    """
    by = list(by)
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_size"))
    largest = sizes.groupBy(*by).agg(F.max("_size").alias("_largest"))
    if by:
        targets = sizes.join(largest, by)
    else:  # one row per class
        targets = F.broadcast(sizes.crossJoin(F.broadcast(largest)))
    hashed = df.withColumn("_order", draws.digest(seed, F.lit(0), *[F.col(k) for k in key]))
    ranked = number_rows(hashed, [*by, label], ["_order", *key], "_position")
    joined = ranked.join(targets, [*by, label])
    copies = F.floor(F.col("_largest") / F.col("_size")) + (
        F.col("_position") <= F.col("_largest") % F.col("_size")
    ).cast("long")
    return joined.withColumn(
        out, F.explode(F.sequence(F.lit(1), copies.cast("int")))
    ).drop("_order", "_position", "_size", "_largest")


def smote(df: DataFrame, key: str, vector: str, y: str, k: int, seed: int) -> DataFrame:
    """Synthetic minority rows between each minority row and one of its k neighbours.

    The minority is the smaller of the two classes (1 if they are equal), and
    each of its rows gets floor((N - P) / P) new points, N and P being the sizes
    of the classes.  Output: source key, synthetic number, neighbour key, gap,
    the new vector and its class.
    """
    sizes = df.agg(F.sum((F.col(y) == 1).cast("long")).alias("ones"), F.count(F.lit(1)).alias("n"))
    least = F.least("ones", F.col("n") - F.col("ones"))
    copies = sizes.select(F.floor(F.try_divide(F.col("n") - 2 * least, least)).cast("int").alias("_copies"),
                          (2 * F.col("ones") <= F.col("n")).cast("int").alias("_minority"))
    minority = df.crossJoin(F.broadcast(copies.select("_minority"))).where(F.col(y) == F.col("_minority")).select(key, vector)  # one row
    near = exact_neighbours(minority, key, vector, k)
    found = near.groupBy(key).agg(F.max("rank").alias("_found"))
    rows = (
        minority.join(found, key).crossJoin(F.broadcast(copies)).where(F.col("_copies") > 0)  # one row
        .withColumn("synthetic", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("_digest", draws.digest(seed, F.col("synthetic"), F.col(key)))
    )
    chosen = rows.withColumn(
        "rank", (F.floor(draws.uniform_at(F.col("_digest"), 0) * F.col("_found")) + 1).cast("int")
    ).withColumn("gap", draws.uniform_at(F.col("_digest"), 1))
    other = minority.select(F.col(key).alias("neighbour"), F.col(vector).alias("_other"))
    moved = F.zip_with(vector, "_other", lambda a, b: a + F.col("gap") * (b - a))
    return (
        chosen.join(near.select(key, "rank", "neighbour"), [key, "rank"])
        .join(other, "neighbour")
        .select(key, "synthetic", "neighbour", "gap", moved.alias(vector), F.col("_minority").cast(df.schema[y].dataType).alias(y))
    )


def permutation_p(observed: DataFrame, permuted: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Two-sided permutation p-value: share of replicates at least as extreme.

    ``n_permutations`` are all replicates; those without a value (fits that did not
    settle) count as extreme, so that they can only make the test more cautious,
    and ``n_settled`` tells how many had one.
    """
    obs = observed.select(*by, F.col(value).alias("_observed"))
    joined = permuted.join(obs, list(by)) if by else permuted.crossJoin(F.broadcast(obs))  # one row
    return joined.groupBy(*by).agg(
        F.max("_observed").alias("observed"),
        F.count(F.lit(1)).alias("n_permutations"), F.count(value).alias("n_settled"),
        F.avg(F.coalesce(F.abs(value) >= F.abs("_observed"), F.lit(True)).cast("double")).alias("p_value"),
    )


def bootstrap_interval(replicates: DataFrame, by: Sequence[str], value: str,
                       level: float = 0.95, null_value: float = 0.0) -> DataFrame:
    """Percentile interval, median and share above the null value.

    A group holds one value per replicate, so the built-in exact percentile is
    bounded by the number of replicates.  ``n_replicates`` counts the replicates with
    a value and ``n_all`` all of them.
    """
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return replicates.groupBy(*by).agg(q.alias("_q"), F.count(value).alias("n_replicates"), F.count(F.lit(1)).alias("n_all"), F.avg(
        (F.col(value) > null_value).cast("double")).alias("share_above")).select(
        *by, "n_replicates", "n_all", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("high"), "share_above")
