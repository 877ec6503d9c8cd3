"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (NULL last) take the weights in turn and
share all words in proportion; no target exceeds ``max_repeat`` times its
source's words, and what is cut off is shared again by weight.  With caps c and
weights w, sorted by c/w, the common level is the largest of
(total - caps before) / (weights from here on), and target = min(c, level * w).

Copies: within a source the documents are ordered by size, each is expected
target / source_size times, the running sum starts at one random offset per
source, and a document is emitted once for every integer the sum crosses.
Ordering by size keeps the words taken within about one longest document of the
target.  A document is emitted at most ``max_repeat`` times.

Defined cases: a NULL source is a source of its own; size 0 or NULL counts as
0 words; a source without words has target 0 and is left out; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortloom.functions import draws
from cohortloom.llm.common import join_small
from cohortloom.operators.ranks import number_rows, prefix_sums
from cohortloom.storage import materialize

WEIGHTS = (5, 2, 1)
_KEY = ["_none", "_source"]


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row per source: ``_none``, ``_source``, ``source_size``, ``target``.

    ``sized`` has the key columns and ``size``.  Ranks and running sums use the
    library's ordered scans, which slice a table too long for one task.
    """
    totals = materialize(sized.groupBy(*_KEY).agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    ranked = number_rows(totals, [], _KEY, "_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.select(*_KEY, "source_size", turn.cast("long").alias("_weight"),
                           (F.col("source_size") * max_repeat).alias("_cap"))
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    scanned = materialize(
        prefix_sums(capped, [], ["_ratio", *_KEY], {"_caps": "_cap", "_weights": "_weight", "_words": "source_size"}, totals=True),
        "mix-scan",
    )
    level = (F.col("_words_total") - F.col("_caps")) / (F.col("_weights_total") - F.col("_weights"))
    best = scanned.agg(F.max(level).alias("_level"))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight"))
    return scanned.crossJoin(F.broadcast(best)).select(*_KEY, "source_size", target.alias("target"))


def plan_copies(docs: DataFrame, order: Sequence[str], source: str = "source", size: str = "size",
                weights: Sequence[int] = WEIGHTS, max_repeat: int = 3, seed: int = 11) -> DataFrame:
    """All columns of ``docs`` plus ``source_size``, ``target`` and ``copies``.

    ``order`` breaks ties of size; rows equal in all of it are interchangeable.
    Rows are dealt by range of (source, size, tie), so a hot source spreads over
    many tasks; in a sorted slice a row's rank is its row number less that of
    the source's first row there, and only slice counts are scanned.
    """
    tie = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    clash = [c for c in ("source_size", "target", "copies") if c in docs.columns]
    keyed = docs.drop(*clash).withColumns({
        "_none": F.col(source).isNull(), "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_tie": tie,
    })
    by = [*_KEY, "_size", "_tie", *order]
    placed = materialize(
        keyed.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
        "mix-rows",
    )
    targets = source_targets(placed.select(*_KEY, F.col("_size").alias("size")), weights, max_repeat)
    slices = placed.groupBy(*_KEY, "_slice").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    earlier = W.partitionBy(*_KEY).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offset = draws.uniform(seed, F.lit(0), F.col("_source"), F.col("_none").cast("string"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    lookup = materialize(
        slices.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        .join(targets, _KEY)
        .select(*_KEY, "_slice", "_first", "_before", "source_size", "target", rate.alias("_rate"), offset.alias("_offset")),
        "mix-slices",
    )
    rank = F.col("_before") + F.col("_row") - F.col("_first")
    crossed = (F.floor(F.col("_offset") + (rank + 1) * F.col("_rate"))
               - F.floor(F.col("_offset") + rank * F.col("_rate"))).cast("int")
    return (
        join_small(placed, lookup, [*_KEY, "_slice"], "inner")
        .withColumn("copies", F.least(crossed, F.lit(max_repeat)))
        .drop(*_KEY, "_size", "_tie", "_slice", "_row", "_first", "_before", "_rate", "_offset")
    )


def emit(planned: DataFrame) -> DataFrame:
    """One row per emitted copy."""
    return planned.where(F.col("copies") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy")
