"""Exact percentiles per key without gathering a key's values in one task.

Different values are counted, equal-width bins over the key's own range are summed, and only the values
of the bins that hold a wanted rank are sorted.

Scale: the one large shuffle is keyed by (keys, value), combined before it; bins are at most BINS rows
a key, and a bin that holds a rank is sorted as (value, count) rows in a window that spills. A
key with a third of all rows is spread like any other. Far outliers widen the bins: then one bin holds
many values, still exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import materialize

BINS = 4096


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """One row per ``key`` with a column for each of ``shares`` (name to a number from 0 to 1), interpolated between
    neighbouring ranks. Null and NaN values do not count; null keys and keys without values have no row."""
    counted = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    counted = counted.dropna().where(~F.isnan("_v")).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = materialize(counted)
    limits = counted.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    slot = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(slot, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = counted.join(limits, "_k").withColumn("_bin", slot)

    def before(*parts, by):
        return F.coalesce(F.sum("_c").over(Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wanted = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), at.alias("at")))
    summed = placed.groupBy("_k", "_bin").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n")).withColumn("_before", before("_k", by="_bin"))
    asked = summed.select("_k", "_bin", "_c", "_before", F.explode(F.array(*wanted)).alias("_w"))
    asked = materialize(asked.where("_w.rank >= _before and _w.rank < _before + _c").select("_k", "_bin", "_before", "_w"))
    inside = placed.join(asked.select("_k", "_bin").distinct(), ["_k", "_bin"]).withColumn("_below", before("_k", "_bin", by="_v"))
    rank = F.col("_w.rank") - F.col("_before")
    found = inside.join(asked, ["_k", "_bin"]).where((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_c")))

    def picked(name, side, what="_v"):
        return F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == side), F.col(what)))

    columns = []
    for name in shares:
        low, high, at = picked(name, "low"), picked(name, "high"), picked(name, "low", "_w.at")
        columns.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return found.groupBy(F.col("_k").alias(key)).agg(*columns)
