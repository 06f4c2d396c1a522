"""Proportional stratified interleaving: shards of equal row counts that all match the source mixture.

Rows of each source are put in a seeded random order; the row of rank r among n gets the position
(r + 1/2) / n. Sorting all rows by position interleaves the sources in proportion, and cutting the
sorted list into equal runs gives shards whose counts differ by one at most and whose mixture
follows the table's. Equal texts are ordinary rows here: they are spread like all others.

Native: DataFrame functions only. Ranks come from two levels, so that neither a hot source nor the
whole table is sorted in one task: a row lies in a bucket of its random key, is numbered within the
bucket, and the bucket's offset comes from a running sum over bucket counts (one row per bucket of
``bucket_rows`` rows). The text is read once, for its size and checksum.

Cases: null text has size 8 and the checksum of the empty text; null source is a source of its own;
null ids are rows like others; repeated rows get slots of their own (equal rows are interchangeable);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import materialize

KEY_BITS = 52


def _numbered(rows: DataFrame, keys: list[str], bucket: str, order: list, n: str) -> DataFrame:
    """Adds ``n``, the rank from 0 of each row under ``keys``, where ``bucket`` ascends with ``order``; and ``n_total``."""
    cell = [*keys, bucket]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_count"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *cell,
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_count").over(group).alias(f"{n}_total"),
    )
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return local.join(offsets, cell).withColumn(n, F.col("_offset") + F.col("_local") - 1).drop("_offset", "_local")


def assign_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 17,
    bucket_rows: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    rows = materialize(rows.withColumn("_key", key))
    buckets = max(1, -(-rows.count() // bucket_rows))

    def bucket(share: Column) -> Column:
        return F.floor(share * buckets)

    keyed = rows.withColumn("_bucket", bucket(F.col("_key") / float(1 << KEY_BITS)))
    ranked = _numbered(keyed, ["source"], "_bucket", ["_key", "doc_id", "text_crc32", "size"], "_rank").drop("_bucket")
    placed = ranked.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_rank_total")).withColumn("_bucket", bucket(F.col("_at")))
    order = ["_at", F.xxhash64(F.lit(seed), "source"), "source", "_rank"]
    lined = _numbered(placed, [], "_bucket", order, "_place")
    return lined.select(
        "doc_id",
        F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"),
        "size",
        "text_crc32",
        F.expr(f"cast(_place * {shards} div _place_total as int)").alias("shard"),
        F.expr(f"_place - ((_place * {shards} div _place_total) * _place_total + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """The rows of ``docs`` as Parquet, one folder per shard, each file in slot order.

    Rows are matched by id, text size and checksum; rows equal in all three go to the shard of the
    first of them.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    first = assigned.groupBy("doc_id", "size", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("_to"))
    match = (
        docs[id_column].eqNullSafe(first["doc_id"])
        & ((F.octet_length(text) + 8) == first["size"])
        & (F.crc32(text) == first["text_crc32"])
    )
    rows = docs.join(first, match).select(*[docs[c] for c in docs.columns], F.col("_to.shard").alias("shard"), F.col("_to.slot").alias("_slot"))
    rows.repartition("shard").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf):
    """Contract query: all documents in shards 0 to 23 under the law of row counts."""
    found = assign_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
