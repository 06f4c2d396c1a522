"""Gaps and islands over intervals, safe for one sequence holding most of the rows.

A window over a whole chromosome would put it into one task. Here every window is keyed by a
bin of the coordinate axis as well; what has to pass from bin to bin (the furthest end so far,
the last island start) is one row per bin and travels in a second, tiny window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 20


def with_island(
    df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, touching: bool = False, binned: bool = True
) -> DataFrame:
    """Adds ``_island``, the first start of the row's island.

    A row opens a new island when its start is at or beyond the furthest end so far plus
    ``gap`` (strictly beyond it, when ``touching`` intervals merge). The binned form reads
    ``df`` more than once, so hand it a table; ``binned=False`` is one plain window per key for
    inputs known to be thin, such as the open rows at chunk borders.
    """

    def opens(reach):
        return F.coalesce(F.col(start) > reach + gap if touching else F.col(start) >= reach + gap, F.lit(True))

    def running(cell):
        return Window.partitionBy(*cell).orderBy(start, end)

    past, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    if not binned:
        flagged = df.withColumn("_opens", opens(F.max(end).over(running(keys).rowsBetween(*past))))
        head = F.max(F.when(F.col("_opens"), F.col(start))).over(running(keys).rowsBetween(*upto))
        return flagged.withColumn("_island", head).drop("_opens")

    cell = [*keys, "_bin"]
    tiles = df.withColumn("_bin", F.floor(F.col(start) / BIN))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*past)
    ends = tiles.groupBy(*cell).agg(F.max(end).alias("_bin_end"))
    carried = ends.select(*cell, F.max("_bin_end").over(before).alias("_carry_end"))
    reach = F.greatest(F.col("_carry_end"), F.max(end).over(running(cell).rowsBetween(*past)))
    flagged = tiles.join(carried, cell).withColumn("_opens", opens(reach))
    head = F.max(F.when(F.col("_opens"), F.col(start))).over(running(cell).rowsBetween(*upto))
    local = flagged.withColumn("_local", head)
    heads = local.groupBy(*cell).agg(F.max("_local").alias("_bin_head"))
    head_carry = heads.select(*cell, F.max("_bin_head").over(before).alias("_carry_head"))
    placed = local.join(head_carry, cell).withColumn("_island", F.coalesce("_local", "_carry_head"))
    return placed.drop("_bin", "_carry_end", "_opens", "_local", "_carry_head")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, aggregates=()) -> DataFrame:
    """One row per island: keys, start, end, n and any extra aggregates. Adjacent intervals merge."""
    marked = with_island(df, keys, start, end, gap, touching=True)
    return (
        marked.groupBy(*keys, "_island")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"), *aggregates)
        .drop("_island")
    )


def covered_length(df: DataFrame, keys: list[str], start: Column, end: Column, width: int = BIN) -> DataFrame:
    """Length of the union of half-open intervals per key, as ``covered``.

    Intervals are clipped to bins first, so unions of different bins simply add up.
    """
    sliced = df.select(*keys, start.alias("_s"), end.alias("_e")).where("_e > _s")
    sliced = sliced.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width)))
    )
    clipped = sliced.select(
        *keys,
        "_bin",
        F.greatest("_s", F.col("_bin") * width).alias("_s"),
        F.least("_e", (F.col("_bin") + 1) * width).alias("_e"),
    )
    earlier = Window.partitionBy(*keys, "_bin").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = clipped.withColumn("_done", F.coalesce(F.max("_e").over(earlier), F.col("_s")))
    gain = F.greatest(F.lit(0), F.col("_e") - F.greatest("_s", "_done"))
    return fresh.groupBy(*keys).agg(F.sum(gain).alias("covered"))
