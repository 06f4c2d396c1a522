"""Phased windows and contributing words are found in the chunk that holds them, whatever the cuts."""

import random

import numpy as np

from helixmill import tables as T
from helixmill.operators import kernels as K
from helixmill.operators.repeats import phased_windows
from helixmill.operators.summaries import contributing_tenmers

SEQUENCES = "seq_id long, seq_name string, bases string"


def test_phased_windows_need_no_join_and_equal_the_whole_sequence(spark):
    r = random.Random(3)
    bases = "".join(r.choices(["AAAAATGCGCG", "AATTTGCACGCC", "ACGTGGC", "TTTTTCGGCA"], [6, 1, 1, 1], k=36_000))
    assert len(bases) > 3 * 100_000
    called = [(s, e, c) for s, e, *_, c in K.at_windows(bases) if c is not None]
    centres, want = np.array([c for *_, c in called]), []
    for run in K.phased_runs(centres):
        start, end = max(0, int(run[0]) - 10), min(len(bases), int(run[-1]) + 10)
        for nth, centre in enumerate(run):
            s, e, c = called[int(np.flatnonzero(centres == centre)[0])]
            want.append((1, start + 1, end, nth, c, s + 1, e, c, 0.0))
    found = phased_windows(spark.createDataFrame([(1, "s", bases), (2, "t", "ACGT")], SEQUENCES))
    assert want and sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_contributing_words_are_found_in_one_process_without_a_window(spark):
    r = random.Random(4)
    bases = "".join(r.choices(["CGCGCGCGCGCG", "ACGTGGCATTA", "GCACGCGTGTGC", "TTAACCA"], k=32_000))
    at, score = K.z_tenmers(K.to_bytes(bases))
    want, region = [], 0
    for n, (start, value) in enumerate(zip(at.tolist(), score.tolist())):
        region = start if not n or start > at[n - 1] + 10 else region
        want.append((1, region + 1, start + 1, bases[start : start + 10], value))
    found = contributing_tenmers(spark.createDataFrame([(1, "s", bases), (2, "t", ""), (3, "u", "ACGTN")], SEQUENCES), T.Z_DNA)
    assert len(bases) > 300_000 and want and sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1
