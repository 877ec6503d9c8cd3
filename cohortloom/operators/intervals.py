"""Range joins on a binned position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.operators.ranks import last_seen
from cohortloom.storage import materialize


def near_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, point: str,
              reach: float) -> DataFrame:
    """Pairs with the same key whose point lies within ``reach`` of [start, end].

    Positions are cut into bins of ``2 * reach``; a left row looks into the
    bins its widened interval touches, a right row lies in exactly one, so each
    pair is found once and by an equi-join on (key, bin) that spreads a large
    key over its bins.
    """
    width = F.lit(2.0 * reach)
    bins = F.sequence(F.floor((F.col(start) - reach) / width), F.floor((F.col(end) + reach) / width))
    looking = left.withColumn("_bin", F.explode(bins))
    placed = right.withColumn("_bin", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col(start) - reach) & (F.col(point) <= F.col(end) + reach)
    return looking.join(placed, [key, "_bin"]).where(inside).drop("_bin")


def nearest_point(left: DataFrame, right: DataFrame, key: str, row: str, start: str, end: str, point: str,
                  name: str, reach: float | None = None) -> DataFrame:
    """For every left row the nearest point of its key, ties by name: ``key``, ``row``, ``name``, ``distance``.

    Points and interval ends are put into one order per key, and two ordered
    scans carry the last point at or before ``start`` and the next one at or after
    ``end`` to the interval, so no pairs are formed; a key too large for one task is
    cut into slices along the order.  Only intervals that hold points strictly
    inside meet these, to find the first of their names.  Without a point of its
    key, or none within ``reach``, a row stays with NULLs; a row whose key or end is
    NULL does too, points with NULLs are left out.
    """
    rows = materialize(left.select(F.col(key), F.col(row), F.col(start).alias("_a"), F.col(end).alias("_z")).withColumn("_id", F.monotonically_increasing_id()), "nearest-rows")
    points = right.select(F.col(key), F.col(point).alias("_p"), F.col(name).alias("_name")).dropna()
    spots = materialize(points.groupBy(key, "_p").agg(F.min("_name").alias("_name")), "nearest-points")
    placed = rows.where(F.col(key).isNotNull() & F.col("_a").isNotNull() & F.col("_z").isNotNull())
    nothing = F.lit(None)
    spot = F.struct("_p", "_name")
    before = last_seen(
        spots.select(key, F.col("_p").alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).cast("long").alias("_id"), spot.alias("_spot"))
        .unionByName(placed.select(key, F.col("_a").alias("_at"), F.lit(1).alias("_kind"), "_id", nothing.cast(spots.select(spot.alias("s")).schema["s"].dataType).alias("_spot"))),
        [key], ["_at", "_kind", "_id"], "_spot", "_before").where("_kind = 1").select("_id", "_before")
    # read backwards: the same scan over negated places
    after = last_seen(
        spots.select(key, (-F.col("_p")).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).cast("long").alias("_id"), spot.alias("_spot"))
        .unionByName(placed.select(key, (-F.col("_z")).alias("_at"), F.lit(1).alias("_kind"), "_id", nothing.cast(spots.select(spot.alias("s")).schema["s"].dataType).alias("_spot"))),
        [key], ["_at", "_kind", "_id"], "_spot", "_after").where("_kind = 1").select("_id", "_after")
    both = materialize(placed.join(before, "_id").join(after, "_id"), "nearest-found")
    # the last point at or before the end lies inside if it is not before the start
    wide = both.where(F.col("_z") > F.col("_a"))
    inside = (
        wide.select("_id", F.col(key).alias("_key"), "_a", "_z")
        .join(spots, (F.col("_key") == F.col(key)) & (F.col("_p") >= F.col("_a")) & (F.col("_p") <= F.col("_z")))
        .groupBy("_id").agg(F.min("_name").alias("_inner"))
    ) if wide.limit(1).count() else None
    gap = lambda c, far: F.when(F.col(c).isNotNull(), F.struct(far.cast("double").alias("distance"), F.col(f"{c}._name").alias("name")))
    left_gap = gap("_before", F.greatest(F.col("_a") - F.col("_before._p"), F.lit(0)))
    right_gap = gap("_after", F.greatest(F.col("_after._p") - F.col("_z"), F.lit(0)))
    found = both.select("_id", F.least(left_gap, right_gap).alias("_best"))
    if inside is not None:
        held = F.when(F.col("_inner").isNotNull(), F.struct(F.lit(0.0).alias("distance"), F.col("_inner").alias("name")))
        found = found.join(inside, "_id", "left").select("_id", F.least("_best", held).alias("_best"))
    if reach is not None:
        found = found.withColumn("_best", F.when(F.col("_best.distance") <= reach, F.col("_best")))
    return rows.join(found, "_id", "left").select(
        key, row, F.col("_best.name").alias(name), F.col("_best.distance").alias("distance"))
