"""Arms and repeats are compared eight bases at a time, and the longest per key comes from one sort."""

import random

import numpy as np
import pytest

from helixmill.operators import kernels as K


def test_walk_equals_a_comparison_base_by_base():
    r = random.Random(8)
    raw = K.to_bytes("".join(r.choice(["ACGTTGCA" * 3, "AC" * 9, "N", "GGT"]) for _ in range(300)))
    left = np.array([r.randrange(len(raw)) for _ in range(2000)])
    delta = np.array([r.randrange(1, 320) for _ in range(2000)])
    most = np.array([r.randrange(0, 300) for _ in range(2000)])
    inside = left + delta < len(raw)
    left, delta, most = left[inside], delta[inside], most[inside]
    want = []
    for i, d, m in zip(left.tolist(), delta.tolist(), most.tolist()):
        n = 0
        while n < m and i + d + n < len(raw) and raw[i + n] == raw[i + d + n]:
            n += 1
        want.append(n)
    assert K._walk(K.byte_words(raw), left, delta, most).tolist() == want and max(want) > 16


@pytest.mark.parametrize("far", [1, 1 << 30])
def test_range_per_key(far):
    r = random.Random(far)
    rows = [(r.randrange(9) * far, r.randrange(4) * far, r.randrange(50)) for _ in range(300)]
    want = {}
    for a, b, v in rows:
        low, high = want.get((a, b), (v, v))
        want[a, b] = min(low, v), max(high, v)
    found = K._range_per_key(*(np.array(x, np.int64) for x in zip(*rows)))
    assert list(zip(*(x.tolist() for x in found))) == [(*key, *value) for key, value in sorted(want.items())]
    assert all(len(x) == 0 for x in K._range_per_key(*[np.empty(0, np.int64)] * 3))
