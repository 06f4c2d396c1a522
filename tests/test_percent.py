"""Percentages that lie between two decimals are rounded as their SQL rounds them."""

import duckdb
import numpy as np

from helixmill.operators import kernels as K


def test_percent_equals_sql():
    for total in (50, 96, 160, 320, 800, 1600, 4000, 20_000):
        want = duckdb.sql(f"SELECT round_even(c * 100.0 / {total}, 2) FROM range({total + 1}) t(c) ORDER BY c").fetchall()
        assert K.percent(np.arange(total + 1), total).tolist() == [x for x, in want]


def test_zone_of_800_bases_on_the_edge():
    # 800 bases with 427 G are 53.375 %: 53.38, not 53.37
    raw = np.frombuffer(b"A" * 50 + b"GA" * 373 + b"G" * 54 + b"A" * 400, np.uint8)
    before = np.concatenate(([0], np.cumsum(raw == ord("G"))))
    assert before[850] - before[50] == 427
    assert K.extension_zone(before, 0, len(raw)) == (50, 850, 53.38)
