"""Greedy interval selection: keep the best interval, drop what overlaps it, repeat.

Greedy selection never crosses connected components of the overlap graph, and an interval that
beats everything it overlaps is selected whatever happens elsewhere. Hence two exact stages:

1. ``settle_in_chunks`` (narrow, no shuffle) decides every candidate that cannot meet a
   candidate of another chunk. It drops the losers where they were found and marks winners as
   settled; only candidates near chunk borders stay open.
2. ``resolve_open`` sorts what is still open by island (connected component) and rank, and
   decides it in one streaming pass.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, StructField, StructType

from helixmill.operators.islands import with_island
from helixmill.session import materialize

ROUND_TILE = 65_536
ORDER_KEYS = ("k1", "k2", "k3", "k4", "k5")


class Cover:
    """A union of half-open intervals on a line."""

    def __init__(self):
        self.starts, self.ends = [], []

    def meets(self, lo, hi) -> bool:
        at = bisect_right(self.ends, lo)
        return at < len(self.starts) and self.starts[at] < hi

    def add(self, lo, hi):
        first, last = bisect_left(self.ends, lo), bisect_right(self.starts, hi)
        if first < last:
            lo, hi = min(lo, self.starts[first]), max(hi, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [lo], [hi]


def open_zone(chunk_start, chunk_end, seq_len, reach):
    """(left, right): an interval outside this range may meet one of another chunk."""
    left = chunk_start + reach if chunk_start > 0 else -1
    right = seq_len + 1 if chunk_end >= seq_len else chunk_end - (25 if reach else 0)
    return left, right


def fates(ranked, left_open, right_open):
    """For intervals in rank order: 0 beaten, 1 wins for certain, 2 depends on another chunk."""
    taken, unknown = Cover(), Cover()
    starts, ends = taken.starts, taken.ends
    for lo, hi in ranked:
        if lo >= hi:
            yield 1
            continue
        at = bisect_right(ends, lo)
        if at < len(starts) and starts[at] < hi:  # most are beaten
            yield 0
        elif lo < left_open or hi > right_open or unknown.meets(lo, hi):
            unknown.add(lo, hi)
            yield 2
        else:
            taken.add(lo, hi)
            yield 1


def settle_in_chunks(df: DataFrame) -> DataFrame:
    """Decide candidates inside their chunk; adds ``settled``.

    Needs the rows exactly as a chunk scan left them (all rows of a chunk adjacent in one
    partition), with columns raw_score, floor, grp, slack, reach, k1..k5. Rows at or below their
    floor are dropped first; filtering here keeps the score from being evaluated twice. ``grp`` null means "nothing to resolve".
    ``reach`` is how far candidates of a neighbouring chunk may extend across the border.
    """
    def column(table, name):
        return table.column(name).to_numpy()

    def decide(table: pa.Table):
        table = table.filter(pa.array(column(table, "raw_score") > column(table, "floor")))
        if not table.num_rows:
            return
        group = table.column("grp").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        seq, chunk = column(table, "seq_id"), column(table, "chunk_start")
        keys = [column(table, k) for k in ORDER_KEYS[::-1]]
        ranked = np.lexsort((*keys, group, chunk, seq))
        lo = (column(table, "start") + column(table, "slack"))[ranked].tolist()
        hi = column(table, "end")[ranked].tolist()
        cell = np.stack((seq, chunk, group))[:, ranked]
        heads = np.concatenate(([0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [len(ranked)]))
        fate = np.ones(len(ranked), np.int8)
        limits = [column(table, n) for n in ("chunk_start", "chunk_end", "seq_len", "reach")]
        for s, e in zip(heads, heads[1:]):
            if cell[2, s] >= 0:
                zone = open_zone(*(int(x[ranked[s]]) for x in limits))
                fate[s:e] = list(fates(zip(lo[s:e], hi[s:e]), *zone))
        by_row = np.empty_like(fate)
        by_row[ranked] = fate
        kept = table.filter(pa.array(by_row > 0))
        yield from kept.append_column("settled", pa.array(by_row[by_row > 0] == 1)).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            seq, chunk = column(table, "seq_id"), column(table, "chunk_start")
            other = np.flatnonzero((seq != seq[-1]) | (chunk != chunk[-1]))
            border = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(border)
            if border:
                yield from decide(table.slice(0, border))
        if held is not None and held.num_rows:
            yield from decide(held)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("settled", BooleanType())]))


def resolve_open(df: DataFrame, binned: bool = False) -> DataFrame:
    """Greedy selection inside each island of (seq_id, grp); columns k1..k5 give the order.

    Rows stream in rank order per island and only the union of what was taken is kept, so an
    island of any size needs no more memory than its winners.
    """
    names = df.columns
    marked = with_island(df.withColumn("_lo", F.col("start") + F.col("slack")), ["seq_id", "grp"], "_lo", "end", binned=binned)
    if binned:
        marked = marked.repartition("seq_id", "grp", "_island")
    ordered = marked.sortWithinPartitions("seq_id", "grp", "_island", *ORDER_KEYS)

    def run(batches):
        island, taken = None, None
        for batch in batches:
            keep = []
            for seq, grp, head, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "grp", "_island", "_lo", "end"))):
                if (seq, grp, head) != island:
                    island, taken = (seq, grp, head), Cover()
                free = lo >= hi or not taken.meets(lo, hi)
                keep.append(free)
                if free and lo < hi:
                    taken.add(lo, hi)
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return ordered.mapInArrow(run, df.schema)


def select_in_rounds(work: DataFrame, tile_len: int = ROUND_TILE) -> DataFrame:
    """Greedy selection of rows (seq_id, grp, start, end, slack, k1..k5) by many tasks, even within one group.

    A row belongs to every tile it touches. Inside one tile nothing outside matters: a row that
    lies whole in it is taken if no better row of the tile meets it, beaten if a taken row does, and
    stays open if its fate hangs on a row that crosses the tile's border. Rows that cross borders
    are beaten as soon as one of their tiles says so. What is left open shows no link to rows taken
    so far, so the next round decides it alone, on tiles eight times as long; a round on tiles longer
    than the sequence leaves nothing. Open rows are few: they hang on a chain of ever better
    overlapping rows that reaches a border. Each round is written once.
    """
    names = work.columns
    live = materialize(work.withColumn("_rid", F.monotonically_increasing_id()))
    taken = []
    while True:
        lo, hi = F.col("start") + F.col("slack"), F.col("end")
        first, last = F.floor(lo / tile_len), F.floor((F.greatest(hi, lo + 1) - 1) / tile_len)
        copies = live.withColumns({"_lo": lo, "_crosses": last > first, "_first": first})
        copies = copies.withColumn("_tile", F.explode(F.sequence("_first", last)))
        cell = ["seq_id", "grp", "_tile"]
        decided = materialize(_decide_cells(copies.repartition(*cell).sortWithinPartitions(*cell, *ORDER_KEYS)))
        taken.append(decided.where("_fate = 1").select(names))
        beaten = decided.where("_crosses and _fate = 0").select("_rid").distinct()
        open_rows = decided.where("_fate = 2 and _tile = _first").join(beaten, "_rid", "left_anti")
        live = materialize(open_rows.select(*names, "_rid"))
        if live.head() is None:
            return reduce(DataFrame.unionByName, taken)
        tile_len *= 8


def _decide_cells(ordered: DataFrame) -> DataFrame:
    """``_fate`` of rows sorted by cell and rank: 0 beaten, 1 taken, 2 open."""

    def run(batches):
        cell, taken, unknown = None, Cover(), Cover()
        for batch in batches:
            fate = np.empty(batch.num_rows, np.int8)
            columns = [batch.column(c).to_pylist() for c in ("seq_id", "grp", "_tile", "_lo", "end", "_crosses")]
            for n, (seq, grp, tile, lo, hi, crosses) in enumerate(zip(*columns)):
                if (seq, grp, tile) != cell:
                    cell, taken, unknown = (seq, grp, tile), Cover(), Cover()
                if lo >= hi:
                    fate[n] = 1
                elif taken.meets(lo, hi):
                    fate[n] = 0
                elif crosses or unknown.meets(lo, hi):
                    unknown.add(lo, hi)
                    fate[n] = 2
                else:
                    taken.add(lo, hi)
                    fate[n] = 1
            yield batch.append_column("_fate", pa.array(fate))

    return ordered.mapInArrow(run, StructType([*ordered.schema.fields, StructField("_fate", ByteType())]))


def select_non_overlapping(
    motifs: DataFrame, group: list[str], order: list[Column], slack: int = 1, start="start", end="end", binned: bool = True
) -> DataFrame:
    """Greedy selection over any motif table.

    ``order`` lists up to five expressions, best first when ascending. ``slack=1`` lets two
    1-based inclusive intervals share one base, ``slack=0`` is the half-open test on the given
    coordinates. ``binned`` finds islands first and decides each as a whole; it reads ``motifs`` more
    than once, so it wants a table. Without it tiles are decided in rounds (``select_in_rounds``),
    which reads ``motifs`` once and cuts islands of any size.
    """
    if len(order) > len(ORDER_KEYS):
        raise ValueError(f"at most {len(ORDER_KEYS)} order expressions")
    keys = [*order, *[F.lit(0.0)] * (len(ORDER_KEYS) - len(order))]
    work = motifs.select(
        F.struct(*motifs.columns).alias("row"),
        F.col("seq_id"),
        F.concat_ws("\u0001", *[F.col(g) for g in group]).alias("grp") if group else F.lit("all").alias("grp"),
        (F.col(start) - 1).alias("start"),
        F.col(end).alias("end"),
        F.lit(slack).alias("slack"),
        *[k.alias(name) for k, name in zip(keys, ORDER_KEYS)],
    )
    return (resolve_open(work, binned=True) if binned else select_in_rounds(work)).select("row.*")
