"""The numpy helpers against plain restatements of what they should find."""

import random
import re

import numpy as np
import pytest

from helixmill import tenmers
from helixmill import tables as T
from helixmill.plans.oracles import A_PHILIC_STEP, Z_STEP
from helixmill.operators import chunks
from helixmill.operators import kernels as K
from helixmill.operators.overlap import Cover, fates
from helixmill.operators.scan import SCANNERS, Chunk, matcher


def random_dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def all_arms(text, k, max_loop, pair):
    best = {}
    for i in range(len(text) - k + 1):
        word = text[i : i + k]
        if set(word) - set("ACGT"):
            continue
        for j in range(i + 1, len(text) - k + 1):
            if text[j : j + k] != pair(word):
                continue
            for arm in range(min(j - i, len(text) - j), max(k, j - i - max_loop) - 1, -1):
                if text[i : i + arm] == pair(text[j : j + arm]):
                    key = (i, j - i - arm)
                    if key not in best or arm > best[key][1]:
                        best[key] = (j, arm)
                    break
    return sorted((i, j, arm) for (i, _), (j, arm) in best.items())


@pytest.mark.parametrize("k,max_loop,complement", [(6, 20, True), (6, 100, True), (10, 30, False)])
def test_paired_arms(k, max_loop, complement):
    rng = random.Random(3)
    pair = K.revcomp if complement else (lambda s: s[::-1])
    texts = [random_dna(rng, rng.randint(5, 250), rng.choice(["ACGT", "AT", "ACGTN"])) for _ in range(12)]
    texts += ["GC" * 5 + "AT" * 230 + random_dna(rng, 30), "TTA" * 150 + "N" + "TTA" * 20, "ACGT" * 110, "A" * 420]
    for text in texts:
        got = sorted(tuple(r[:3]) for r in K.paired_arms(K.to_bytes(text), k, max_loop, len(text), complement).tolist())
        assert got == all_arms(text, k, max_loop, pair)


def test_direct_repeats():
    rng = random.Random(4)
    for n in range(20):
        text = random_dna(rng, rng.randint(15, 400), rng.choice(["ACGT", "AT", "A"]))
        if n % 2:
            unit = text[: rng.randint(10, 90)]
            text = unit + "ACG"[: n % 4] + unit + text + "N" + unit
        best = {}
        for i in range(len(text) - 9):
            for j in range(i + 1, min(len(text) - 9, i + 311)):
                if text[i : i + 10] == text[j : j + 10] and not set(text[i : i + 10]) - set("ACGT"):
                    for unit in range(min(300, j - i), max(10, j - i - 10) - 1, -1):
                        if j + unit <= len(text) and text[i : i + unit] == text[j : j + unit]:
                            key = (i, j - i - unit)
                            best[key] = max(best.get(key, 0), unit)
                            break
        got = sorted(map(tuple, K.direct_repeats(K.to_bytes(text), len(text)).tolist()))
        assert got == sorted((i, u, s) for (i, s), u in best.items())


def test_tandem_repeats():
    rng = random.Random(5)
    for _ in range(60):
        text = random_dna(rng, rng.randint(5, 120), rng.choice(["AC", "ACGT", "A"])) + rng.choice(["", "CAG" * 5, "ATATATATATA"])
        for unit in T.STR_UNITS:
            want, i = [], 0
            while i <= len(text) - unit:
                copies = 1
                while text[i + copies * unit : i + (copies + 1) * unit] == text[i : i + unit]:
                    copies += 1
                if copies > 1 and copies * unit >= 10:
                    want.append((i, copies))
                    i += copies * unit
                else:
                    i += 1
            assert K.tandem_repeats(K.to_bytes(text), unit) == want


@pytest.mark.parametrize("regex", [r"([ATGC]{2,})(?:[ATGC]{0,50})\1", r"([ATGC]{3,20})(?:[ATGC]{0,100})\1"])
def test_spaced_repeats_equal_the_back_reference(regex):
    rng = random.Random(6)
    for n in range(60):
        text = random_dna(rng, rng.randint(3, 260), rng.choice(["ACGT", "AT", "ACGTN"])) * (1 + n % 2)
        assert matcher(regex)(text) == [m.span() for m in re.finditer(regex, text)]


def test_scored_tenmers():
    assert K.z_tenmers(K.to_bytes("CGCGCGCGCG"))[1].tolist() == [63.0]
    assert K.z_tenmers(K.to_bytes("NGCGCGCGCG"))[0].tolist() == []
    at, score = K.a_philic_tenmers(K.to_bytes("AGGGGGGGGG"))
    assert at.tolist() == [0] and score[0] == pytest.approx(2.702428571428571)
    for word, score in tenmers.Z_DNA.items():
        assert score == sum(Z_STEP.get(word[p : p + 2], 0) for p in range(9)) >= 50
    for word, score in tenmers.A_PHILIC.items():
        assert score == pytest.approx(sum(A_PHILIC_STEP[word[p : p + 4]] for p in range(7)) / 7)


def test_at_window_profile():
    assert K.at_window_profile("AAATTT") == (6, 5, 0)
    assert K.at_window_profile("TTTTA") == (1, 4, 4)
    assert K.at_window_profile("AATTTT") == (4, 3, 2)


def test_greedy_fates_match_a_plain_greedy():
    rng = random.Random(7)
    for _ in range(50):
        spans = [(s, s + rng.randint(1, 40)) for s in (rng.randint(0, 300) for _ in range(60))]
        taken, want = [], []
        for lo, hi in spans:
            free = all(hi <= a or lo >= b for a, b in taken)
            want.append(int(free))
            if free:
                taken.append((lo, hi))
        assert list(fates(spans, -1, 10_000)) == want
        decided = list(fates(spans, 100, 200))
        assert all(d == 2 or d == w for d, w in zip(decided, want))


def test_cover():
    cover = Cover()
    cover.add(5, 10)
    cover.add(20, 30)
    assert not cover.meets(10, 20) and cover.meets(9, 11) and cover.meets(0, 100)
    cover.add(10, 20)
    assert cover.starts == [5] and cover.ends == [30]


def test_local_scans_do_not_depend_on_cuts():
    rng = random.Random(8)
    parts = ["GGGTTAGGGTTAGGGTTAGGG", "CGCGCGCGCGCG", "AAAAATGCGCGAAAAATGCGCGAAAAATGCGCG", "CACACACACACACA", "AAATTGCCCCTTGACCCTTGACCC", "TAGGGGGGGGGT", "GAA" * 7, "A" * 30]
    text = "".join(random_dna(rng, rng.randint(5, 80)) + rng.choice(parts) for _ in range(150))
    for det in (T.CURVED, T.R_LOOP, T.G4, T.I_MOTIF, T.Z_DNA, T.A_PHILIC):
        key = lambda row, lo: (row["family"], row["start"] + lo, min(row["end"], 10**9) + lo)
        whole = sorted(key(r, 0) for r in SCANNERS[det](Chunk(text, len(text))))
        pieces = []
        for lo, hi, reach, piece in chunks.cut_sequence(text, 700, 4200):
            pieces += [key(r, lo) for r in SCANNERS[det](Chunk(piece, hi - lo, lo, len(text), reach, text.find))]
        assert sorted(pieces) == whole
    assert len(list(chunks.cut_sequence(text, 700, 4200))) > 5


def test_context_covers_long_palindromes():
    rng = random.Random(9)
    arm = random_dna(rng, 5000)
    text = random_dna(rng, 3000) + arm + "ACGTA" + K.revcomp(arm) + random_dna(rng, 3000)
    pieces = list(chunks.cut_sequence(text, 2000, 4200))
    whole = K.paired_arms(K.to_bytes(text), 6, 100, len(text), True)
    split = [
        (left + lo, right + lo, size)
        for lo, hi, _, piece in pieces
        for left, right, size, _ in K.paired_arms(K.to_bytes(piece), 6, 100, hi - lo, True).tolist()
    ]
    assert sorted(split) == sorted(tuple(r[:3]) for r in whole.tolist())
    assert np.max(whole[:, 2]) > 2000


def test_tandem_score_is_the_best_repeat_inside():
    """Against a plain search over every offset and unit of the block."""

    def search(text):
        best = 0.0
        for unit in range(1, len(text) // 3 + 1):
            for i in range(len(text) - 3 * unit + 1):
                word, copies = text[i : i + unit], 1
                while "N" not in word and text.startswith(word, i + copies * unit):
                    copies += 1
                if copies >= 3 and copies * unit >= 10 and unit <= 9:
                    best = max(best, copies * unit**0.5)
        return min(best / 10, 1.0) if best <= 8 else 1.0

    rng = random.Random(7)
    for _ in range(1500):
        unit = "".join(rng.choice("AACGTN" if rng.random() < 0.2 else "AAC") for _ in range(rng.randint(1, 9)))
        copies = rng.randint(2, 14)
        if len(unit) * copies >= 10:
            assert abs(K.tandem_score(unit, copies) - search(unit * copies)) < 1e-12


def test_array_scores_equal_plain_searches():
    from helixmill.functions import scoring as S

    def instability(s):
        best = 0.0
        for unit in range(1, min(7, len(s) // 3)):
            for i in range(len(s) - 2 * unit):
                copies = 1
                while s[i + copies * unit : i + (copies + 1) * unit] == s[i : i + unit]:
                    copies += 1
                best = max(best, copies * unit**0.5 if copies >= 3 else 0)
        return min(best / 10, 1.0) if len(s) >= 6 else 0.0

    def palindrome(s):
        best = max((j - i for i in range(len(s)) for j in range(i + 8, len(s) + 1) if s[i:j] == K.revcomp(s[i:j])), default=0)
        return min(best**1.5 / len(s), 1.0) if best else 0.0

    def direct(s):
        n, best = len(s), 0.0
        for unit in range(10, min(301, n // 2 + 1)):
            for i in range(n - 2 * unit - 10 + 1):
                for gap in range(min(11, n - i - 2 * unit)):
                    if s[i + unit + gap : i + 2 * unit + gap] == s[i : i + unit]:
                        best = max(best, unit / (1 + gap))
        return min(best / 50, 1.0)

    rng = random.Random(12)
    for n in range(250):
        text = random_dna(rng, rng.randint(1, 90), rng.choice(["ACGT", "AC", "ACGTN", "A"]))
        text = text + random_dna(rng, rng.randint(0, 9)) + (text if n % 3 == 0 else K.revcomp(text) if n % 3 == 1 else "")
        raw = K.to_bytes(text)
        assert abs(S._instability(raw) - instability(text)) < 1e-12
        assert abs(S._palindrome(raw) - palindrome(text)) < 1e-12
        assert abs(S._direct_repeat(raw) - direct(text)) < 1e-12


@pytest.mark.parametrize("regex", ["([ATGC]{8,})(?:[ATGC]{0,9})\\1", "([ATGC]{10,})(?:[ATGC]{0,3})\\1"])
def test_long_spaced_repeats_equal_the_back_reference(regex):
    rng = random.Random(13)
    for n in range(40):
        parts = []
        for _ in range(6):
            unit = random_dna(rng, rng.choice([12, 70, 150, 400]))
            parts += [random_dna(rng, rng.randint(0, 60)), unit, random_dna(rng, rng.randint(0, 10)), unit * rng.choice([1, 1, 3])]
        text = "".join(parts)
        assert matcher(regex)(text) == [m.span() for m in re.finditer(regex, text)]


def test_spaced_repeats_in_long_text_are_not_quadratic():
    import time

    rng = random.Random(14)
    seconds = []
    for n in (40_000, 160_000):
        raw = K.to_bytes(random_dna(rng, n))
        began = time.process_time()
        K.spaced_repeats(raw, 10, None, 10)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * max(seconds[0], 0.05)
