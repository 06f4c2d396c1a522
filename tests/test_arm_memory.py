"""Paired arms: what is held at once follows the hits, and limits do not change the hits."""

import random
import tracemalloc

import numpy as np

from helixmill.operators import kernels as K
from helixmill.operators import repeats
from helixmill.sources.fasta import sequences_from_dict


def low_complexity(n):
    r = random.Random(8)
    return K.to_bytes("".join(r.choice("AT") for _ in range(n)))


def test_arms_of_repeats_are_not_held_all_at_once(monkeypatch):
    r = random.Random(9)
    raw = K.to_bytes("".join("GCC" * r.randint(5, 35) + "".join(r.choice("ACGT") for _ in range(9)) + "GGC" * r.randint(5, 35) for _ in range(100)))
    monkeypatch.setattr(K, "_PAIRS_AT_ONCE", 1 << 14)
    monkeypatch.setattr(K, "_HELD_ARMS", 1 << 16)
    tracemalloc.start()
    K.paired_arms(raw, 6, 100, len(raw), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_limits_do_not_change_the_arms(monkeypatch):
    raw = low_complexity(3_000)
    whole = K.paired_arms(raw, 6, 100, 2_500, True)
    for name, value in (("_PAIRS_AT_ONCE", 300), ("_PAIR_BLOCK", 64), ("_HELD_ARMS", 500)):
        monkeypatch.setattr(K, name, value)
    assert np.array_equal(whole, K.paired_arms(raw, 6, 100, 2_500, True))


def test_rows_leave_in_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ROWS_AT_ONCE", 7)
    text = low_complexity(400).tobytes().decode()
    rows = repeats.inverted_repeats(sequences_from_dict(spark, {"a": text, "b": "ACG", "c": text[:50]})).collect()
    want = [len(K.paired_arms(K.to_bytes(t), 6, 100, len(t), True)) for t in (text, "ACG", text[:50])]
    assert len(rows) == sum(want)
    assert all(r.right_start - r.left_start - r.arm == r.loop for r in rows)


def test_partners_are_searched_by_word_and_not_at_every_distance(monkeypatch):
    raw = K.to_bytes("".join(random.Random(3).choices("ACGT", k=3_000)))
    own, pair = K.word_codes(raw, 6), K.word_codes(raw, 6, "revcomp")
    calls, nonzero = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or nonzero(x))
    found = np.concatenate([np.stack(x) for x in K._paired_words(own, pair, own >= 0, 6, 100)], 1)
    assert len(calls) < 10
    assert sorted(map(tuple, found.T.tolist())) == [(i, j) for i in range(len(own)) for j in range(i + 6, min(i + 107, len(own))) if own[i] == pair[j]]
