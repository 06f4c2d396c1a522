"""Short sequences share the calls of the pairing kernels, and find what they find alone."""

import random

from helixmill import tables as T
from helixmill.operators import kernels as K
from helixmill.operators import scan as S

KEYS = ("family", "start", "end", "seen", "unit", "copies", "arm", "loop", "raw")


def _texts():
    rng = random.Random(5)
    texts = ["", "A", "ACGTN" * 9, "AG" * 60, "TAAA" * 40, "GAAGAA" * 9, "N" * 40, "ACGT" * 5]
    for n in range(200):
        half = "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 90)))
        texts.append(half + "".join(rng.choice("AG") for _ in range(rng.randint(0, 60))) + (K.revcomp(half) if n % 2 else half[::-1]) + half)
    return texts


def _found(chunks):
    return [(n, det, *(row.get(k) for k in KEYS)) for n, c in chunks for det in S.SCANNERS for row in S.SCANNERS[det](c)]


def _chunks():
    return [(n, S.Chunk(text, len(text))) for n, text in enumerate(_texts())]


def test_groups_find_what_single_sequences_find():
    alone, grouped = _found(_chunks()), _found(S._grouped(_chunks()))
    assert len({row[2] for row in alone}) > 5
    assert grouped == alone


def test_a_group_makes_one_call(monkeypatch):
    calls, arms = [], K.paired_arms
    monkeypatch.setattr(K, "paired_arms", lambda *args, **named: calls.append(1) or arms(*args, **named))
    found = [row for _, c in S._grouped(_chunks()) for row in S.SCANNERS[T.CRUCIFORM](c)]
    assert found and len(calls) <= 12  # three sequences are too short for a group; before, one call each


def test_beaten_triplex_hits_stay_in_their_chunk():
    text = "TAACTAATCC" + "AAAG" * 300 + "CTGACTGATC"
    every, rivals = (list(S.SCANNERS[T.TRIPLEX](S.Chunk(text, len(text), every=e))) for e in (True, False))
    assert len(rivals) * 20 < len(every)
    taken, kept = [], []
    for row in every:  # rank order: no overlap with what was taken
        if all(row["end"] <= s or e <= row["start"] for s, e in taken):
            taken.append((row["start"], row["end"]))
            kept.append(row)
    assert [r for r in rivals if (r["start"], r["end"]) in taken] == kept
