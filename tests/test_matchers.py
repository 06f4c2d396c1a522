"""Searches that stand in for a pattern find what the pattern finds, without trying every place."""

import random
import re
import time

import pytest

from helixmill import catalogs
from helixmill.operators import kernels as K
from helixmill.operators.scan import matcher, needles

TANDEM = [r"([ATGC])\1{9,}", r"([ATGC]{2})\1{4,}", r"([ATGC]{3})\1{3,}", r"([ATGC]{1,6})\1{3,}", r"([ACGT]{1,6})\1{2,}"]


def _texts():
    r = random.Random(5)
    for n in range(150):
        text = "".join(r.choice(["A", "AC", "ACG", "GGTA", "TCTCA", "N", "acgt"]) * r.randrange(1, 9) for _ in range(r.randrange(12)))
        yield text + "A" * (n % 14)


@pytest.mark.parametrize("regex", TANDEM)
def test_tandem_units(regex):
    letters = re.compile(regex)
    for text in (t.upper() for t in _texts()):
        assert matcher(regex)(text) == [m.span() for m in letters.finditer(text)]


def test_texts_without_a_needed_word_are_left_out_for_good_reason():
    regexes = {row[3] for name in ("registry", "legacy", "seed", "detector") for row in catalogs.rows(name) if row[3]}
    regexes |= {"(?:AC|CA)GT{2,}", "ACGTACGT?A", "(?=AAAAAAAA)A", "(?!CCCCCC)ACG", "(?:GGGGGG)?T", "AC{0,3}GTTTTTTT|ACG"}
    assert any(needles(x) for x in regexes)
    words = [w for x in regexes for clause in needles(x) for w in clause]
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choice([r.choice(words), r.choice("ACGT") * r.randrange(9), "ACG", "gaagaagaagaa"]) for _ in range(9))
        for regex in regexes - {x for x in regexes if "\\1" in x}:
            assert matcher(regex)(text) == [m.span() for m in re.finditer(regex, text, re.I | re.A)], regex


def test_long_tracts_without_the_second_half_are_not_tried_from_every_place():
    began = time.time()
    assert matcher("(?:GA){6,}[GA]*(?:TC){6,}")("GA" * 20_000) == []
    assert time.time() - began < 1


def test_near_units_are_looked_up_only_where_a_hit_may_begin(monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice("ACGT") for _ in range(4000))
    asked, best = [], K._best_near
    monkeypatch.setattr(K, "_best_near", lambda text, i, *rest: asked.append(i) or best(text, i, *rest))
    found = K.spaced_repeats(K.to_bytes(text), 2, 20, 50)
    assert found == [m.span() for m in re.finditer(r"([ATGC]{2,20})(?:[ATGC]{0,50})\1", text)]
    assert len(asked) < 2 * len(found)
