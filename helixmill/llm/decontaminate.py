"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased and cut into words at white space; the set of a text is its different
five-word shingles, or the whole sequence as one shingle when it has fewer words. An item is found in a document
that contains at least ``threshold`` of the item's shingles, wherever they stand.

1. Items are partitioned by set size into classes [2^c, 2^(c+1)). The MinHash sketch of an item is
   its k smallest shingle hashes, where k depends on the size so that a document may lack at most
   k - 1 shingles of a match: every match shares at least one sketch value (no match is missed,
   whatever the length of the document). A class states the least size a document must have.
2. Every document probes the sketches with all its shingles; documents smaller than the class
   allows are passed over. Few documents become candidates.
3. Candidates are verified by counting the different shingles they share with the item exactly.

Native: DataFrame functions only. Documents are read twice, in narrow passes; only hits are
shuffled, aggregated before. The item side is broadcast only if it has at most
``BROADCAST_SHINGLES`` rows, else joined by its hash.

Cases: null or empty texts and items have no shingles and match nothing; null ids take no part (a
document without id is returned as clean); ids that repeat are one document or item that holds the
shingles of all their rows; an empty table on either side gives clean documents; other columns are
kept by ``drop_contaminated`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.session import materialize

WORDS, THRESHOLD = 5, 0.75
BROADCAST_SHINGLES = 200_000
#: the text in lower case, cut at ASCII white space
BLANKS = "[ \\t-\\r]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BLANKS), "")


def shingle_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per place: the keys, the text's number of places and the words w0..w4 (fewer words: the rest is null)."""
    rows = texts.select(*keys, words_of(F.col("text")).alias("_w"))
    count = F.greatest(F.size("_w") - (WORDS - 1), F.lit(1))
    columns = [F.slice("_w", n + 1, count) for n in range(WORDS)]
    zipped = F.arrays_zip(*[c.alias(f"w{n}") for n, c in enumerate(columns)])
    return rows.select(*keys, count.alias("n_places"), F.inline(zipped))


def shingle() -> Column:
    return F.concat_ws(" ", *[f"w{n}" for n in range(WORDS)])


def hash_of_row() -> Column:
    return F.xxhash64(*[f"w{n}" for n in range(WORDS)])


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, hash and size class of every different shingle of every item."""
    rows = shingle_rows(items.where("item_id is not null and text is not null"), ["item_id"])
    different = rows.select("item_id", shingle().alias("shingle"), hash_of_row().alias("hash")).distinct()
    sizes = different.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return different.join(sizes, "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """Per item its smallest hashes, as many as make a match without any of them impossible."""
    need = F.ceil(F.col("n_item") * threshold - 1e-9)
    grouped = shingles.groupBy("item_id", "n_item").agg(F.sort_array(F.collect_set("hash")).alias("_all"))
    size_class = F.floor(F.log2(F.col("n_item")))
    least = F.ceil(F.pow(F.lit(2.0), size_class) * threshold - 1e-9)
    taken = F.slice("_all", 1, (F.col("n_item") - need + 1).cast("int"))
    return grouped.select("item_id", least.alias("least_size"), F.explode(taken).alias("hash"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SHINGLES else df


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item and n_shared of every document and item it contains."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    known = materialize(item_shingles(items.select("item_id", F.col("text").cast("string").alias("text"))))
    rows = known.count()
    probes = _sized(sketches(known, threshold), rows)
    hits = shingle_rows(texts, ["doc_id"]).withColumn("hash", hash_of_row()).join(probes, "hash")
    candidates = materialize(hits.where("n_places >= least_size").select("doc_id", "item_id").distinct())
    again = shingle_rows(texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"])
    shared = (
        again.withColumn("shingle", shingle()).join(_sized(known.select("shingle", "item_id", "n_item"), rows), "shingle")
        .select("doc_id", "item_id", "n_item", "shingle").distinct()
        .groupBy("doc_id", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    )
    exact = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    return exact.join(candidates, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_item", "n_shared")


def mark_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, contaminated, n_items and the smallest item found, for every row of ``docs``."""
    found = find_contamination(docs, items, threshold).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "first_item",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    found = find_contamination(docs, items, threshold).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op2_decontamination(spark, sf):
    """Every document that contains a benchmark item, with the item and the shingles it shares."""
    docs, items = (spark.read.parquet(f"{sf}/{table}.parquet") for table in ("documents", "benchmark"))
    return find_contamination(docs, items)


def _sql_set(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, array_to_string(list_slice(w, i, least(i + {WORDS - 1}, len(w))), ' ') AS shingle
    FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS i
          FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w
                FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)
          WHERE len(w) > 0)"""


ORACLE = f"""
WITH item AS ({_sql_set("benchmark", "item_id")}),
     doc AS ({_sql_set("documents", "doc_id")}),
     size AS (SELECT item_id, count(*) AS n FROM item GROUP BY 1)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared FROM doc JOIN item USING (shingle) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(n * 0.75)"""
