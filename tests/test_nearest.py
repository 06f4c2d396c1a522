"""Nearest and as-of joins against a plain search."""

import random

import pytest

from helixmill.operators.nearest import nearest_join
from helixmill.operators.repeats import a_tract_windows, called_windows, phased_windows

LEFT, RIGHT = "seq_id long, pos long, note string", "seq_id long, pos long, score double, note string"


def plain(row, rights, direction, limit):
    best = None
    for r in rights:
        if None in (row[0], row[1], r[1]) or r[0] != row[0]:
            continue
        gap = r[1] - row[1]
        if (direction == "backward" and gap > 0) or (direction == "forward" and gap < 0) or (limit is not None and abs(gap) > limit):
            continue
        order = (abs(gap), gap, r[1:])
        if best is None or order < best[0]:
            best = (order, r)
    return (*row, *best[1][1:], float(best[1][1] - row[1])) if best else (*row, None, None, None, None)


@pytest.mark.parametrize("direction,limit", [("nearest", None), ("backward", None), ("forward", None), ("nearest", 9), ("backward", 0)])
@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_equals_a_plain_search(spark, direction, limit, tile):
    r = random.Random(tile)
    left = [(r.randrange(4), r.randrange(-50, 600), f"l{n}") for n in range(150)] + [(1, 77, "hot")] * 40
    left += [(None, 4, "no key"), (1, None, "no place"), (7, 5, "nobody there")]
    right = [(r.randrange(3), r.randrange(600) // 20 * 20, r.randrange(9) / 2, "x") for _ in range(60)]
    right += [(None, 4, 1.0, "n"), (1, None, 1.0, "n"), (3, 300, 0.5, "far"), (1, 77, 2.0, "b"), (1, 77, 2.0, "b")]
    found = nearest_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["seq_id"], "pos", direction=direction, max_distance=limit, tile=tile)
    assert found.columns == ["seq_id", "pos", "note", "near_pos", "near_score", "near_note", "distance"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain(row, right, direction, limit) for row in left), key=repr)


def test_empty_sides_and_clashes(spark):
    rows = spark.createDataFrame([(1, 5, "a")], LEFT)
    assert nearest_join(rows.limit(0), spark.createDataFrame([(1, 2, 0.5, "x")], RIGHT), ["seq_id"], "pos").count() == 0
    alone = nearest_join(rows, spark.createDataFrame([], RIGHT), ["seq_id"], "pos").collect()
    assert [tuple(x) for x in alone] == [(1, 5, "a", None, None, None, None)]
    with pytest.raises(ValueError):
        nearest_join(rows.withColumnRenamed("note", "near_note"), spark.createDataFrame([], RIGHT), ["seq_id"], "pos")
    with pytest.raises(ValueError):
        nearest_join(rows, rows, ["seq_id"], "pos", direction="up")


def test_centres_of_phased_runs_have_their_window(spark):
    bases = "CGTGCA" + "AAAAATGCGCG" * 6 + "GCCGTACG" * 5 + "AAAAACGCGTC" * 4
    found = phased_windows(spark.createDataFrame([(1, "s", bases), (2, "t", "ACGT")], "seq_id long, seq_name string, bases string")).collect()
    assert len(found) >= 6
    assert all(x.distance == 0 and x.window_start - 1 <= x.center <= x.window_end for x in found)


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_rows_said_to_be_distinct_need_not_be(spark, tile):
    r = random.Random(9)
    left = [(r.randrange(3), r.randrange(-50, 600), f"l{n}") for n in range(150)]
    right = [(r.randrange(3), r.randrange(600) // 20 * 20, r.randrange(9) / 2, "x") for _ in range(90)]
    sides = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    found = nearest_join(*sides, ["seq_id"], "pos", tile=tile, distinct=True)
    assert sorted(map(tuple, found.collect())) == sorted(plain(row, right, "nearest", None) for row in left)
    plans = [nearest_join(*sides, ["seq_id"], "pos", distinct=d)._jdf.queryExecution().optimizedPlan().toString() for d in (True, False)]
    assert plans[0].count("Aggregate") < plans[1].count("Aggregate")


def test_called_windows_are_the_called_ones_of_all(spark):
    bases = "".join(random.Random(2).choices(["AAAAATGC", "TTTAAG", "CGN", "TATATAC"], k=30_000))
    sequences = spark.createDataFrame([(1, "s", bases), (2, "t", "")], "seq_id long, seq_name string, bases string")
    assert len(bases) > 150_000
    want = a_tract_windows(sequences).where("call").select("seq_id", "start", "end").collect()
    assert want and sorted(called_windows(sequences).collect()) == sorted(want)
