"""Ordered computations over groups of any size.

A plain window sorts a whole group in one task.  Here a group that is large is
cut into slices along its sort order, each slice is scanned by its own task,
and the slice totals (a few thousand rows at most per group) are carried
forward.  Results are exact; groups that fit one task keep the plain window.

Slice bounds are rows picked by a hash of their content, so they are the same
in every evaluation of the plan, also after a lost executor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortloom.storage import materialize

SLICE = "_slice"
ROWS_SETTING = "cohortloom.rowsPerSlice"
_DEFAULT_ROWS = 1 << 20
_MAX_BOUNDS_PER_GROUP = 4095
_MAX_BROADCAST_BOUNDS = 1_000_000


def rows_per_slice(df: DataFrame) -> int:
    """Rows one task may sort; session setting ``cohortloom.rowsPerSlice``."""
    return int(df.sparkSession.conf.get(ROWS_SETTING, str(_DEFAULT_ROWS)))


def _position(bounds: Column, key: Column) -> Column:
    """How many of the sorted ``bounds`` are <= key, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(12))])

    def step(pos, width):
        reached = (pos + width <= F.size(bounds)) & (
            F.try_element_at(bounds, pos + width) <= key
        )
        return F.when(reached, pos + width).otherwise(pos)

    return F.when(bounds.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), step))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing group key meets itself, as it does in a window."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def slice_groups(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Add ``_slice``, rising along ``order`` inside each group; None if no group needs it.

    ``order`` must identify a row within its group and hold no NULL.  Only groups
    of more rows than a task may sort are sliced; all others are one slice.
    """
    rows = rows_per_slice(df)
    picked = df.where(
        F.pmod(F.xxhash64(*by, *order), F.lit(rows)) == 0
    ).select(*by, F.struct(*order).alias("_key"))
    count = picked.count()
    if count == 0:
        return None
    large = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows), "large-groups")
    if large.limit(1).count() == 0:
        return None
    if by:
        picked = _null_safe_join(picked, large.drop("_rows"), by)
    stride = F.greatest(F.lit(1), F.ceil(F.size("_all") / F.lit(_MAX_BOUNDS_PER_GROUP)))
    bounds = materialize(
        picked.groupBy(*by)
        .agg(F.array_sort(F.collect_set("_key")).alias("_all"))
        .select(*by, stride.alias("_stride"), "_all")
        .select(*by, F.filter("_all", lambda _, i: i % F.col("_stride") == 0).alias("_bounds")),
        "slice-bounds",
    )
    # about one bound per rows_per_slice rows: broadcast only when that is few
    small = F.broadcast(bounds) if count <= _MAX_BROADCAST_BOUNDS else bounds
    joined = _null_safe_join(df, small, by, "left") if by else df.crossJoin(F.broadcast(bounds))  # one row
    return joined.withColumn(SLICE, _position(F.col("_bounds"), F.struct(*order))).drop("_bounds")


def value_slices(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame | None:
    """Add ``_slice``, rising along ``value`` in each group of more rows than a task may sort; None if there is none.

    Bounds are values of rows picked by a hash.  A bound is a slice of its own, with an odd number; the
    values between two bounds have an even one.  So equal values share a slice, and a value of very many
    rows, which is picked, stands alone.  ``_slice`` is NULL in smaller groups.
    """
    rows = rows_per_slice(df)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = materialize(sizes.where(F.col("_rows") > rows).select(*by), "large-groups")
    if large.limit(1).count() == 0:
        return None
    picked = df.where(F.pmod(F.xxhash64(*by, value, key), F.lit(max(1, rows // 4))) == 0).select(*by, F.col(value).alias("_key"))
    stride = F.greatest(F.lit(1), F.ceil(F.size("_all") / F.lit(_MAX_BOUNDS_PER_GROUP)))
    bounds = materialize(
        _null_safe_join(large, picked, by, "left").groupBy(*by)
        .agg(F.array_sort(F.collect_set("_key")).alias("_all"))
        .select(*by, stride.alias("_stride"), "_all")
        .select(*by, F.filter("_all", lambda _, i: i % F.col("_stride") == 0).alias("_bounds")),
        "slice-bounds",
    )
    joined = _null_safe_join(df, bounds, by, "left")
    at = _position(F.col("_bounds"), F.col(value))
    alone = (at > 0) & (F.try_element_at("_bounds", F.greatest(at, F.lit(1))) == F.col(value))
    return joined.withColumn(SLICE, F.when(F.col("_bounds").isNotNull(), 2 * at - F.when(alone, 1).otherwise(0))).drop("_bounds")


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str],
                sums: Mapping[str, Column | str], totals: bool = False,
                small_groups: bool = False) -> DataFrame:
    """Running sums over the rows that come earlier in each group.

    For each ``name: value`` adds ``name`` = sum of value over strictly earlier
    rows (0 for the first), and with ``totals`` also ``name_total``.
    ``small_groups`` tells that the caller has checked the group sizes.
    """
    by, order = list(by), list(order)
    sliced = None if small_groups else slice_groups(df, by, order)
    sums = {n: (F.col(v) if isinstance(v, str) else v) for n, v in sums.items()}
    keys = by + [SLICE] if sliced is not None else by
    source = sliced if sliced is not None else df
    place = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = place.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = {n: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for n, v in sums.items()}
    if sliced is None:
        if totals:
            local.update({f"{n}_total": F.sum(v).over(place) for n, v in sums.items()})
        return source.withColumns(local)
    # the carried sums: at most a few thousand slices per group
    per_slice = source.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = {f"_carry_{n}": F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in sums}
    if totals:
        carried.update({f"{n}_total": F.sum(f"_sum_{n}").over(group) for n in sums})
    offsets = per_slice.withColumns(carried).drop(*[f"_sum_{n}" for n in sums])
    scanned = _null_safe_join(source.withColumns(local), offsets, keys)
    added = {n: F.col(n) + F.col(f"_carry_{n}") for n in sums}
    return scanned.withColumns(added).drop(SLICE, *[f"_carry_{n}" for n in sums])


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str],
                name: str, total: str | None = None, small_groups: bool = False) -> DataFrame:
    """Number the rows of each group from 1; optionally add the group size."""
    one = F.lit(1).cast("long")
    out = prefix_sums(df, by, order, {"_n": one}, total is not None, small_groups)
    out = out.withColumn(name, F.col("_n") + 1).drop("_n")
    return out.withColumnRenamed("_n_total", total) if total else out


def later_minimum(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  value: str, name: str, small_groups: bool = False) -> DataFrame:
    """Minimum of ``value`` over this row and all later rows of the group."""
    by, order = list(by), list(order)
    sliced = None if small_groups else slice_groups(df, by, order)
    keys = by + [SLICE] if sliced is not None else by
    source = sliced if sliced is not None else df
    place = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    # read backwards: a frame that ends at the last row is recomputed for every row
    onward = place.orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    if sliced is None:
        return source.withColumn(name, F.min(value).over(onward))
    per_slice = source.groupBy(*keys).agg(F.min(value).alias("_low"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    after = group.orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.withColumn("_later", F.min("_low").over(after)).drop("_low")
    scanned = _null_safe_join(source.withColumn(name, F.min(value).over(onward)), offsets, keys)
    return scanned.withColumn(name, F.least(name, "_later")).drop(SLICE, "_later")


def last_seen(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The last value that is not NULL among this row and the earlier ones of its group."""
    by, order = list(by), list(order)
    sliced = slice_groups(df, by, order)
    keys = by + [SLICE] if sliced is not None else by
    source = sliced if sliced is not None else df
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = source.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    if sliced is None:
        return local
    held = source.where(F.col(value).isNotNull())
    ends = source.select(*keys).distinct().join(
        held.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_end")), keys, "left")
    before = W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return _null_safe_join(local, carried, keys).withColumn(name, F.coalesce(name, "_carry")).drop(SLICE, "_carry")


def adjust_fdr(df: DataFrame, by: Sequence[str], p: str, key: Sequence[str], name: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each group.

    ``key`` identifies a row in its group.  A NULL p stays NULL and does not
    count as a test.
    """
    order = ["_p", *key]
    tested = df.withColumn("_p", F.coalesce(p, F.lit(2.0)))
    small = slice_groups(tested, by, order) is None
    ranked = prefix_sums(
        tested, by, order,
        {"_rank": F.lit(1).cast("long"), "_tests": F.col(p).isNotNull().cast("long")}, totals=True,
        small_groups=small,
    )
    scaled = ranked.withColumn(
        "_scaled", F.col(p) * F.col("_tests_total") / (F.col("_rank") + 1)
    ).drop("_rank", "_tests", "_rank_total", "_tests_total")
    out = later_minimum(scaled, by, order, "_scaled", "_q", small_groups=small)
    capped = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "_q"))
    return out.withColumn(name, capped).drop("_p", "_scaled", "_q")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7), one row per group.

    Equal values are counted before anything is shuffled; no group is
    collected.  For groups whose size is a small parameter (resamples of one
    feature) the built-in ``percentile`` is enough.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_count")
    )
    ranked = prefix_sums(counted, by, [value], {"_before": "_count"}, totals=True)
    last = F.col("_before_total") - 1

    def at(index: Column) -> Column:
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_count"))
        return F.max(F.when(inside, F.col(value)))

    aggregates, results = [], []
    for name, prob in probs.items():
        spot = last * F.lit(float(prob))
        low, high = f"_low_{name}", f"_high_{name}"
        aggregates += [at(F.floor(spot)).alias(low), at(F.ceil(spot)).alias(high)]
        aggregates.append(F.max(spot - F.floor(spot)).alias(f"_share_{name}"))
        gap = F.col(high) - F.col(low)
        results.append((F.col(low) + F.col(f"_share_{name}") * gap).alias(name))
    return ranked.groupBy(*by).agg(*aggregates).select(*by, *results)


def rank_auc(df: DataFrame, by: Sequence[str], score: str, y: str, name: str = "auc") -> DataFrame:
    """Exact area under the ROC curve, ties counted as half; higher score = positive.

    Scores are reduced to per-value class counts first.  A group with a single
    class has no AUC (NULL).
    """
    by = list(by)
    counted = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("_neg"),
    )
    ranked = prefix_sums(counted, by, [score], {"_neg_before": "_neg"})
    wins = F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / F.lit(2.0))
    return (
        ranked.groupBy(*by)
        .agg(F.sum(wins).alias("_wins"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
        .withColumn(name, F.try_divide("_wins", F.col("n_pos").cast("double") * F.col("n_neg")))
        .select(*by, "n_pos", "n_neg", name)
    )
