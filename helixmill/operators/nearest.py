"""Nearest and as-of joins along a coordinate.

Both sides are reduced to their distinct positions, united and cut into tiles of the axis; inside a
tile windows find the last position at or before and the first at or after each one. What lies
beyond a tile comes from one carry row per tile, in a second, tiny window. A join back by position
gives every left row its partner.

Scale: shuffles are keyed by (keys, tile), so a chromosome is many groups, and a tile holds at most
its width in positions however many rows share them: a third of all rows on one position is one
row in the window, and the join back has a unique right side, which skew handling can split. At
100 times the data there are 100 times as many tiles; a 250 Mb chromosome has 3 800 carry rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def nearest_join(
    left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str | None = None,
    direction: str = "nearest", max_distance: float | None = None, prefix: str = "near_", tile: int = TILE, distinct: bool = False,
) -> DataFrame:
    """Every left row with the right row of the same keys that is closest in position.

    direction: ``nearest`` (ties go to the left), ``backward`` (at or before) or ``forward`` (at or
    after). Right columns other than the keys are added under ``prefix``, with ``distance`` (right minus left
    position). Of right rows that share keys and position the smallest row counts. A left row without a partner, or
    beyond ``max_distance``, or with a null key or position, is kept with nulls; right rows with
    such nulls are never partners. Right columns must be orderable; positions are numbers. Both sides are read twice.
    ``distinct`` says that few right rows share a position, which saves a shuffle; the result is the same if it is not so.
    """
    right_on = right_on or on
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    taken = [c for c in right.columns if c not in keys]
    clash = {f"{prefix}{c}" for c in taken} | {"distance", "_at", "_row", "_hit"}
    if clash & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash & set(left.columns))}")

    def known(df, at):
        return df.dropna(subset=[*keys, at]).select(*keys, F.col(at).cast("double").alias("_at"), *([] if df is left else taken))

    cell, place = [*keys, "_tile"], F.floor(F.col("_at") / tile).alias("_tile")
    rights = known(right, right_on).select(*keys, "_at", F.struct(*taken).alias("_row"))
    if not distinct:
        rights = rights.groupBy(*keys, "_at").agg(F.min("_row").alias("_row"))
    rights = rights.select(*keys, "_at", place, F.struct(F.col("_at").alias("at"), F.col("_row").alias("row")).alias("_hit"))
    spots = known(left, on).groupBy(*keys, "_at").agg(F.lit(True).alias("_asked")).select("*", place)
    both = rights.withColumn("_asked", F.lit(False)).unionByName(spots, allowMissingColumns=True)

    by_key = Window.partitionBy(*keys).orderBy("_tile")
    back = F.min(F.struct(-F.col("_at"), "_hit"))["_hit"]  # the last position, of its rows the smallest
    ends = rights.groupBy(*cell).agg(F.min("_hit").alias("_first"), back.alias("_last"))
    ends = spots.select(*cell).distinct().join(ends, cell, "full")
    carry = ends.select(
        *cell,
        F.last("_last", True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_left"),
        F.first("_first", True).over(by_key.rowsBetween(1, Window.unboundedFollowing)).alias("_from_right"),
    )
    # at one position right rows come first, so that they count in either direction, the smallest of them last
    past = Window.partitionBy(*cell).rowsBetween(Window.unboundedPreceding, 0)
    tie = ["_asked", F.desc("_hit")]
    near = both.select(
        "*",
        F.last("_hit", True).over(past.orderBy("_at", *tie)).alias("_in_left"),
        F.last("_hit", True).over(past.orderBy(F.desc("_at"), *tie)).alias("_in_right"),
    ).where("_asked")
    near = near.join(carry, cell)
    before, after = F.coalesce("_in_left", "_from_left"), F.coalesce("_in_right", "_from_right")
    back, ahead = F.col("_at") - before["at"], after["at"] - F.col("_at")
    best = {
        "backward": before,
        "forward": after,
        "nearest": F.when(after.isNull() | (back <= ahead), before).otherwise(after),
    }[direction]
    found = near.select(*keys, "_at", best.alias("_hit")).where("_hit is not null")
    if max_distance is not None:
        found = found.where(F.abs(F.col("_hit.at") - F.col("_at")) <= max_distance)
    joined = left.withColumn("_at", F.col(on).cast("double")).join(found, [*keys, "_at"], "left")
    return joined.select(
        *left.columns,
        *[F.col(f"_hit.row.{c}").alias(f"{prefix}{c}") for c in taken],
        (F.col("_hit.at") - F.col("_at")).alias("distance"),
    )
