import random
from collections import defaultdict

import pytest

from helixmill.operators.ordinals import numbered


def test_numbers_equal_a_plain_sort(spark):
    """Hot key, ties, null keys, null and negative positions, tiles without rows."""
    r = random.Random(5)
    rows = [("a", r.randrange(-50, 900), r.choice("xyz"), n) for n in range(600)]
    rows += [(r.choice(["b", "c", None]), r.choice([None, 3, 64, 5000]), r.choice("xyz"), 1000 + n) for n in range(200)]
    table = spark.createDataFrame(rows, "seq string, at long, kind string, id long").repartition(7)
    found = numbered(table, ["seq"], "at", ["kind", "id"], tile=64)
    assert found.columns == ["seq", "at", "kind", "id", "number"]
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    expected = {}
    for members in groups.values():
        members.sort(key=lambda m: (m[1] is not None, m[1] or 0, m[2], m[3]))
        expected |= {m[3]: n for n, m in enumerate(members, 1)}
    got = found.collect()
    assert len(got) == len(rows) and {g.id: g.number for g in got} == expected


def test_no_rows_and_taken_names(spark):
    empty = spark.createDataFrame([], "seq string, at long")
    assert numbered(empty, ["seq"], "at", []).collect() == []
    with pytest.raises(ValueError):
        numbered(empty.withColumnRenamed("at", "number"), ["seq"], "number", [])
