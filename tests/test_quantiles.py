import random

import numpy as np

from helixmill.operators.quantiles import percentiles


def test_percentiles_equal_a_plain_sort(spark):
    """A hot key, one value, two values, far outliers, ties and nulls."""
    r = random.Random(11)
    groups = {
        "hot": [round(r.random(), 2) for _ in range(900)],
        "one": [4.0],
        "same": [2.5] * 7,
        "two": [1.0, 2.0],
        "far": [r.random() for _ in range(50)] + [1e9, -1e9],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("hot", None), (None, 1.0), ("none", None), ("hot", float("nan"))]
    table = spark.createDataFrame(rows, "class string, score double").repartition(5)
    shares = {"first": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "last": 1.0}
    found = {row["class"]: row for row in percentiles(table, "class", "score", shares, bins=16).collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        for name, share in shares.items():
            assert np.isclose(found[key][name], np.quantile(values, share), rtol=1e-9, atol=1e-9), (key, name)


def test_no_values(spark):
    empty = spark.createDataFrame([], "class string, score double")
    assert percentiles(empty, "class", "score", {"q1": 0.25}).collect() == []
