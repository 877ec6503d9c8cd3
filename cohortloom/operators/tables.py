"""Shaping of study tables: columns, reshaping, filters, joins, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.operators.ranks import _position, exact_quantiles, number_rows

_FEATURES_IN_BLOCK = 8192
_FEATURES_IN_TILE = 256
_CELLS_IN_TASK = 1 << 24
_LEAST_CELLS = 1 << 18
_BROADCAST_BLOCKS = 256


# ---- columns -------------------------------------------------------------

def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def columns_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def across(df: DataFrame, columns: Sequence[str], expression) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    return df.withColumns({c: expression(F.col(c)) for c in columns})


def map_features(ids: DataFrame, annotation: DataFrame, id_col: str, annotation_id: str,
                 mapped: str, position: str, annotation_order: str) -> DataFrame:
    """Name features by an annotation table.

    The first annotation row of an id in ``annotation_order`` wins; ids without a
    name are dropped; repeated names get ``.1``, ``.2``, ... in ``position``
    order, past numbers whose result is itself a name.
    """
    first = (
        annotation.groupBy(F.col(annotation_id).alias(id_col))
        .agg(F.min_by(mapped, annotation_order).alias(mapped))
        .where(F.col(mapped).isNotNull() & (F.col(mapped) != ""))
    )
    named = ids.join(first, id_col)
    numbered = number_rows(named, [mapped], [position, id_col], "_copy")
    # names that look like a numbered copy of another one
    shape = r"^(?s:(.*))\.([1-9][0-9]{0,8})$"
    taken = (
        named.select(F.regexp_extract(mapped, shape, 1).alias(mapped), F.regexp_extract(mapped, shape, 2).alias("_number"))
        .where("_number <> ''").groupBy(mapped)
        .agg(F.array_sort(F.collect_set(F.col("_number").cast("long"))).alias("_taken"))
    )
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<long>")), F.col("_copy").cast("long") - 1,
                       lambda n, used: F.when(used <= n, n + 1).otherwise(n))
    suffixed = F.when(F.col("_copy") == 1, F.col(mapped)).otherwise(F.concat_ws(".", F.col(mapped), free.cast("string")))
    return numbered.join(taken, mapped, "left").withColumn(mapped, suffixed).drop("_copy", "_taken").select(*named.columns)


def treatment_contrasts(column: str, levels: Sequence, prefix: str) -> dict[str, Column]:
    """0/1 columns against the first level."""
    return {
        f"{prefix}{i}": (F.col(column) == level).cast("double")
        for i, level in enumerate(levels[1:], start=1)
    }


def sum_contrasts(column: str, levels: Sequence, prefix: str) -> dict[str, Column]:
    """1/0/-1 columns that add up to zero over the levels; the last level is -1."""
    last = F.col(column) == levels[-1]
    return {
        f"{prefix}{i}": F.when(last, -1.0).otherwise((F.col(column) == level).cast("double"))
        for i, level in enumerate(levels[:-1], start=1)
    }


def interaction(left: Mapping[str, Column], right: Mapping[str, Column]) -> dict[str, Column]:
    return {f"{a}_x_{b}": ca * cb for a, ca in left.items() for b, cb in right.items()}


# ---- reshaping -----------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; a narrow step, no shuffle."""
    columns = columns or [c for c in df.columns if c not in set(ids)]
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str,
            names: Sequence) -> DataFrame:
    """Long to wide; the names are given, so no extra job looks for them."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def complete_grid(df: DataFrame, row: str, feature: str, value: str, rows: DataFrame | None = None,
                  features: DataFrame | None = None, fill: float = 0.0,
                  each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every (row, feature) pair of a sparse long matrix; absent pairs get ``fill``.

    ``rows`` and ``features`` are the two margins, by default those of ``df``.  The
    result is the matrix itself, as large as it is in dense form, but its cells are
    never shuffled: the features are cut into blocks of tiles, and the absent cells of a
    row in a tile are the stretches of the tile's sorted list between those it holds.
    A task makes its cells tile by tile, row by row, so that a columnar writer finds the
    row and the value repeated and the same few names over and over.

    ``each`` adds columns that depend on ``value`` alone, row by row; it is applied once
    for all absent cells of a row in a block.
    """
    used = df.where(F.col(row).isNotNull() & F.col(feature).isNotNull())
    used = used if rows is None else used.join(rows.select(row), row, "left_semi")
    used = used if features is None else used.join(features.select(feature), feature, "left_semi")
    rows = (df if rows is None else rows).select(row).distinct()
    features = (df if features is None else features).select(feature).distinct()
    kind = df.withColumn(value, F.when(F.lit(True), F.col(value)).otherwise(F.lit(fill))).schema[value].dataType
    present = used.select(row, feature, F.col(value).cast(kind).alias(value))
    n_features = features.count()
    count, cells = -(-n_features // _FEATURES_IN_BLOCK), rows.count() * n_features
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-cells // _LEAST_CELLS))
    tiles = max(1, count, -(-n_features // _FEATURES_IN_TILE))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles))
    block = lambda c: F.pmod(c, F.lit(max(1, count)).cast("long"))
    lists = features.where(F.col(feature).isNotNull()).groupBy(tile(feature).alias("_tile")).agg(F.sort_array(F.collect_list(feature)).alias("_all"))
    held = present.groupBy(row, block(tile(feature)).alias("_block")).agg(F.collect_set(feature).alias("_held"))
    named = held.select(F.col(row).alias("_row"), F.col("_block").alias("_at"), "_held")
    places = rows.crossJoin(df.sparkSession.range(count).withColumnRenamed("id", "_block"))
    met = places.join(named, (F.col(row) == F.col("_row")) & (F.col("_block") == F.col("_at")), "left").select(row, "_block", "_held")
    empty = F.lit(fill).cast(kind)
    complete = each or (lambda cells: cells)
    cell = complete(present.select(row, feature, value))
    others = [c for c in cell.columns if c not in (row, feature)]
    # the rows of a task are few bytes before their cells are made, so their number is set here
    met = complete(met.withColumn(value, empty)).repartitionByRange(max(1, cores, -(-cells // _CELLS_IN_TASK)), "_block", row)
    marked = F.transform("_held", lambda f: F.struct(tile(f).alias("tile"), f.alias("name")))
    here = F.transform(F.filter("_marked", lambda h: h["tile"] == F.col("_tile")), lambda h: h["name"])
    tiled = met.withColumn("_marked", marked).select(row, "_marked", F.explode(F.sequence("_block", F.lit(tiles - 1), F.lit(max(1, count)))).alias("_tile"), *others)
    tiled = tiled.select(row, "_tile", here.alias("_held"), *others)
    # the filter holds for every row and keeps the optimizer from dropping the order below the join
    tiled = tiled.sortWithinPartitions("_tile", row).where(F.spark_partition_id() >= 0).join(F.broadcast(lists) if count <= _BROADCAST_BLOCKS else lists, "_tile")
    ends = F.transform("_held", lambda f: _position(F.col("_all"), f))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce(F.sort_array(ends), F.array().cast("array<int>")), F.array(F.size("_all") + 1))
    stretches = tiled.withColumn("_bounds", bounds).withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("_bounds") - 1)))
    low, high = F.element_at("_bounds", F.col("_from")), F.element_at("_bounds", F.col("_from") + 1)
    absent = stretches.select(row, F.explode(F.slice("_all", low + 1, high - low - 1)).alias(feature), *others)
    # a feature that is NULL is in no list and meets nothing
    unnamed = complete(rows.crossJoin(features.where(F.col(feature).isNull())).select(row, feature, empty.alias(value)))
    return cell.unionByName(absent).unionByName(unnamed)


def assemble(df: DataFrame, ids: Sequence[str], feature: str, value: str, out: str = "features",
             panel: DataFrame | None = None, fill: float | None = None) -> DataFrame:
    """One array per row key over the panel, ordered by feature.

    ``panel`` has the features, by default those of ``df``; the position of a feature
    is its place in the panel in every row.  A pair that is absent, or NULL, is
    ``fill``, which is NULL by default.
    """
    panel = (df if panel is None else panel).select(feature).distinct()
    grid = df.select(*ids).distinct().crossJoin(panel)
    names = [*ids, feature]
    other = df.select(*names, value).withColumnsRenamed({k: f"_right_{k}" for k in names})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in names]
    full = grid.join(other, same, "left").withColumn(value, F.col(value) if fill is None else F.coalesce(value, F.lit(fill)))
    pairs = F.array_sort(F.collect_list(F.struct(feature, value)))
    return full.groupBy(*ids).agg(F.transform(pairs, lambda p: p[value]).alias(out))


# ---- filters -------------------------------------------------------------

def present(column: str) -> Column:
    """Neither missing nor blank."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def keep_repeated(df: DataFrame, key: str, at_least: int = 2, distinct: str | None = None) -> DataFrame:
    """Rows of keys with enough rows (or enough distinct values of a column).

    Counts are reduced map-side and joined back as a semi join, so a key that
    holds much of the table is never gathered in one place.
    """
    if distinct:
        pairs = df.select(key, distinct).distinct()
        counts = pairs.groupBy(key).agg(F.count(distinct).alias("_n"))
    else:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts.where(F.col("_n") >= at_least).select(key), key, "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in a stated order, by a map-side reducible aggregate."""
    rest = [c for c in df.columns if c not in set(keys)]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def drop_position(df: DataFrame, order: Sequence[str], position: int) -> DataFrame:
    """Leave out the row at one position (from 1) of the ordered table."""
    return number_rows(df, [], order, "_pos").where(F.col("_pos") != position).drop("_pos")


def feature_quality(df: DataFrame, feature: str, value: str, n_samples: Column | int,
                    detect_above: float = 1.0) -> DataFrame:
    """Total, variance and detection share of every feature in one aggregate.

    Samples without a row for a feature count as zero, so a sparse long table
    gives the same answer as the full matrix.
    """
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    # mean and squared deviations of the present values, then the zeros folded in
    moments = df.groupBy(feature).agg(
        F.sum(value).alias("total"),
        F.count(value).alias("_present"),
        F.avg(value).alias("_mean"),
        F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_var"),
        F.sum((F.col(value) > detect_above).cast("long")).alias("_detected"),
    )
    absent = n - F.col("_present")
    spread = F.col("_present") * F.col("_var") + F.col("_present") * absent / n * F.pow("_mean", 2)
    return moments.select(
        feature, "total",
        F.try_divide(spread, n - 1).alias("variance"),
        (F.col("_detected") / n).alias("detected"),
    )


def passing_features(quality: DataFrame, min_share: float = 0.2) -> DataFrame:
    return quality.where(
        (F.col("total") > 0) & (F.col("variance") > 0) & (F.col("detected") >= min_share)
    )


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables hold the same keys."""
    for a, b, side in ((left, right, "left"), (right, left, "right")):
        missing = a.join(b, key, "left_anti").select(key).limit(5).collect()
        if missing:
            raise ValueError(f"{key} only in the {side} table: {[r[0] for r in missing]}")


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys held by only one of two tables."""
    only_left = left.join(right, key, "left_anti").select(key, F.lit("left").alias("side"))
    only_right = right.join(left, key, "left_anti").select(key, F.lit("right").alias("side"))
    return only_left.unionByName(only_right).distinct()


# ---- joins ---------------------------------------------------------------

def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all common columns."""
    common = [c for c in left.columns if c in set(right.columns)]
    if not common:
        raise ValueError("no common columns")
    return left.join(right, common)


def na_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
            na_matches: bool = False) -> DataFrame:
    """Join on one key; ``na_matches`` lets missing keys meet each other."""
    if not na_matches:
        return left.join(right, key, how)
    other = right.withColumnRenamed(key, "_key")
    joined = left.join(other, F.col(key).eqNullSafe(F.col("_key")), how)
    return joined.drop("_key")


def left_join_chain(base: DataFrame, others: Sequence[DataFrame], key: str,
                    check_unique: bool = True) -> DataFrame:
    """Left-join several tables; a repeated key on the right raises by default."""
    out = base
    for other in others:
        if check_unique:
            repeated = other.groupBy(key).count().where("count > 1").limit(3).collect()
            if repeated:
                raise ValueError(f"{key} is not unique: {[r[0] for r in repeated]}")
        out = out.join(other, key, "left")
    return out


def full_join_tables(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables, their columns suffixed by the table's name."""
    out = None
    for tag, df in tables.items():
        renamed = df.select(key, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != key])
        out = renamed if out is None else out.join(renamed, key, "full")
    return out


# ---- summaries -----------------------------------------------------------

def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum by group."""
    return exact_quantiles(
        df, by, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value."""
    edges = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = (F.col("_max") - F.col("_min")) / F.lit(float(bins))
    spot = F.floor(F.try_divide(F.col(value) - F.col("_min"), width)) + 1
    return (
        df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges))  # one row
        .groupBy(F.least(F.coalesce(spot, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sign_consistency(effects: DataFrame, feature: str, estimate: str, mostly: float = 0.8) -> DataFrame:
    """How often a feature's effect keeps its sign."""
    known = F.col(estimate).isNotNull()
    shares = effects.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n_visits"),
        F.avg(F.when(known, (F.col(estimate) > 0).cast("double"))).alias("frac_pos"),
        F.avg(F.when(known, (F.col(estimate) < 0).cast("double"))).alias("frac_neg"),
    )
    return shares.withColumns({
        "all_same": (F.col("frac_pos") == 1) | (F.col("frac_neg") == 1),
        "mostly_same": (F.col("frac_pos") >= mostly) | (F.col("frac_neg") >= mostly),
    })


def class_means(df: DataFrame, feature: str, value: str, y: str) -> DataFrame:
    """Mean of each feature per class and the direction of the difference."""
    means = df.groupBy(feature).agg(
        F.avg(F.when(F.col(y) == 1, F.col(value))).alias("mean_pos"),
        F.avg(F.when(F.col(y) == 0, F.col(value))).alias("mean_neg"),
    )
    falls = F.col("mean_pos") - F.col("mean_neg") < 0
    return means.withColumn("direction", F.when(falls, "down").when(~falls, "up"))
