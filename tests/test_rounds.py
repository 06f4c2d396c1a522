"""Selection in rounds against the plain greedy rule: dense text, chains over many tiles, long intervals, ties."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import overlap
from helixmill.operators.overlap import select_in_rounds

WORK = "seq_id long, grp string, start long, end long, slack int, n int, k1 double, k2 double, k3 double, k4 double, k5 double"


def rows_of(kind, r):
    if kind == "dense":
        return [(s, s + r.randrange(1, 60), r.randrange(20)) for s in (r.randrange(900) for _ in range(400))]
    if kind == "chain":  # every interval is beaten by its right neighbour, over all tiles
        return [(7 * n, 7 * n + 9, 1000 - n) for n in range(120)]
    if kind == "long":
        return [(r.randrange(500), r.randrange(500, 1000), r.randrange(50)) for _ in range(40)] + [(n, n + 5, n % 60) for n in range(0, 1000, 3)]
    return [(n // 4, n // 4 + r.randrange(3), 0) for n in range(200)]  # ties, empty intervals


def plain(rows):
    kept = []
    for row in sorted(rows, key=lambda x: x[6:]):
        lo, hi = row[2] + row[4], row[3]
        if lo >= hi or all(hi <= a or lo >= b for g, a, b, _ in kept if g == row[:2] and a < b):
            kept.append((row[:2], lo, hi, row[5]))
    return sorted(k[3] for k in kept)


@pytest.mark.parametrize("tile_len", [16, 64, 5000])
def test_rounds_equal_the_plain_greedy_rule(spark, tile_len):
    r, rows = random.Random(tile_len), []
    for seq, kind in enumerate(("dense", "chain", "long", "ties")):
        for grp in "ab":
            for s, e, key in rows_of(kind, r):
                rows.append((seq, grp, s, e, int(grp == "a"), len(rows), float(key), float(s), float(len(rows)), 0.0, 0.0))
    found = select_in_rounds(spark.createDataFrame(rows, WORK), tile_len)
    assert found.columns == [c.split()[0] for c in WORK.split(", ")]
    assert sorted(x.n for x in found.collect()) == plain(rows)


def test_no_rows(spark):
    assert select_in_rounds(spark.createDataFrame([], WORK)).count() == 0


def test_both_forms_of_the_operator_agree(spark, monkeypatch):
    monkeypatch.setattr(overlap.select_in_rounds, "__defaults__", (40,))
    r = random.Random(9)
    rows = [(n % 3, "xy"[n % 2], s := r.randrange(1, 800), s + r.randrange(50), r.random()) for n in range(900)]
    motifs = spark.createDataFrame(rows, "seq_id long, class string, start long, end long, score double")
    order = [-F.col("score"), F.col("start")]
    one = overlap.select_non_overlapping(motifs, ["class"], order, binned=True).collect()
    two = overlap.select_non_overlapping(motifs, ["class"], order, binned=False).collect()
    assert sorted(one) == sorted(two)
