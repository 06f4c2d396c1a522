"""Spaced repeats look only at distances where words recur, and find what the pattern finds."""

import random
import re

import numpy as np
import pytest

from helixmill.operators import kernels as K

CASES = [(5, 20, 100), (10, 50, 200), (2, None, 50), (3, 20, 100), (5, None, 3)]


def _texts():
    rng = random.Random(11)
    for n in range(60):
        text = "".join(rng.choice(rng.choice(["AC", "ACGT", "AAAT"])) for _ in range(rng.randint(0, 90)))
        yield text
        yield text + "T" * n + text
        yield ("ACGTTG" * 30)[: 3 * n]


@pytest.mark.parametrize("least, most, gap", CASES)
def test_equals_the_pattern(least, most, gap):
    pattern = re.compile(r"([ATGC]{%d,%s})(?:[ATGC]{0,%d})\1" % (least, "" if most is None else most, gap))
    for text in _texts():
        assert K.spaced_repeats(K.to_bytes(text), least, most, gap) == [m.span() for m in pattern.finditer(text)]


def test_far_distances_without_a_recurring_word_are_not_compared(monkeypatch):
    rng = random.Random(2)
    unit = "".join(rng.choice("ACGT") for _ in range(300))
    text = unit + "".join(rng.choice("ACGT") for _ in range(40)) + unit + "".join(rng.choice("ACGT") for _ in range(2000))
    compared, long_runs = [], K._long_runs
    monkeypatch.setattr(K, "_long_runs", lambda *args: compared.append(args[2]) or long_runs(*args))
    found = K.spaced_repeats(K.to_bytes(text), 2, None, 50)
    assert found[0][1] >= 640 and compared == [340]  # before, all of some 1 200 distances
    assert np.all(np.diff([s for s, _ in found]) > 0)
