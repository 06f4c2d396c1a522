"""Exact top-k inner products with MaxScore over lanes of vectors.

A query's terms are its dimensions. In a block of vectors each term has a score bound, the most
that any vector of the block can gain from it. With the k-th best score so far as the bar, terms
are split: the *non-essential* ones, taken by rising bounds, cannot reach the bar together, so a
vector must be found through the *essential* ones, whose postings are traversed and summed; the
non-essential terms are then probed, largest bound first, only for vectors that are still
competitive. The bar rises from block to block of a lane. The best k of every lane are merged.

Scale: queries lie in groups of about ``group_queries``, vectors in lanes of about ``lane_rows``
(both dealt by hash, so equal vectors spread); each pair of group and lane is one task-sized unit
of bounded memory, and k rows per query and lane are merged by rank. The work is the stated query
set against all rows, in blocks; nothing is broadcast or collected.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null
ids; a repeated vec_id is one vector, the first in array order; shorter vectors count as ending in
zeros; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import materialize

BLOCK_ROWS = 4096


def integer_vectors(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vec (floor of scale times each component) of every usable vector."""
    values = F.col(column).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_column).isNotNull() & (F.size(values) > 0) & ~bad)
    whole = F.transform(values, lambda x: F.floor(x * scale))
    rows = usable.select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(lists), width), np.int64)
    matrix[np.arange(width)[None, :] < sizes[:, None]] = flat
    return matrix


def longest(column: pa.ChunkedArray) -> int:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return int(np.diff(lists.offsets.to_numpy()).max(initial=0))


class Best:
    """The k best (score, id) met by one query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Postings:
    """A block of vectors by dimension, with the range of components of each."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(matrix.T)
        self.high, self.low = matrix.max(axis=0, initial=0), matrix.min(axis=0, initial=0)

    def search(self, query_id: int, query: np.ndarray, best: Best) -> None:
        bounds = np.maximum(query * self.high, query * self.low)
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        bar = best.bar
        split = 0 if bar is None else int(np.searchsorted(reach, bar, side="left"))
        partial = np.zeros(len(self.ids), np.int64)
        for term in order[split:]:
            if query[term]:
                partial += query[term] * self.columns[term]
        alive = np.flatnonzero(self.ids != query_id)
        partial = partial[alive]
        for at in range(split, 0, -4):  # probe four terms, then look who is still competitive
            keep = partial + reach[at - 1] >= bar
            alive, partial = alive[keep], partial[keep]
            for term in order[max(0, at - 4) : at]:
                partial = partial + query[term] * self.columns[term][alive]
        if bar is not None:
            keep = partial >= bar
            alive, partial = alive[keep], partial[keep]
        if len(partial) > best.k:  # ties at the k-th score are all kept for the merge by id
            least = np.partition(partial, len(partial) - best.k)[len(partial) - best.k]
            alive, partial = alive[partial >= least], partial[partial >= least]
        best.add(partial, self.ids[alive])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, lane_rows: int = 16_384, group_queries: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for every row of ``queries``.

    Both hold ``vec_id`` and the integer array ``vec``; a row is no candidate for its own id.
    """
    lanes = max(1, -(-vectors.count() // lane_rows))
    groups = max(1, -(-queries.count() // group_queries))

    def dealt(df, own, n, other, m):
        mine = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(queries.select("vec_id", "vec"), "group", groups, "lane", lanes)
    right = dealt(vectors.select("vec_id", "vec"), "lane", lanes, "group", groups)

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        width = max(longest(asked["vec"]), longest(rows["vec"]))
        query_ids, wanted = asked["vec_id"].to_numpy(), as_matrix(asked["vec"], width)
        best = [Best(k) for _ in query_ids]
        ids, matrix = rows["vec_id"].to_numpy(), as_matrix(rows["vec"], width)
        for at in range(0, len(ids), BLOCK_ROWS):
            block = Postings(ids[at : at + BLOCK_ROWS], matrix[at : at + BLOCK_ROWS])
            for n in range(len(query_ids)):
                block.search(query_ids[n], wanted[n], best[n])
        sizes = [len(b.ids) for b in best]
        return pa.table(
            {
                "query_id": np.repeat(query_ids, sizes),
                "vec_id": np.concatenate([np.zeros(0, np.int64), *[b.ids for b in best]]),
                "score": np.concatenate([np.zeros(0, np.int64), *[b.scores for b in best]]),
            }
        )

    found = left.groupBy("group", "lane").cogroup(right.groupBy("group", "lane"))
    found = found.applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf):
    """Contract query: the 5 best of all vectors for every vec_id divisible by 50."""
    vectors = materialize(integer_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
