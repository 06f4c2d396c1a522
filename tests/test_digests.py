"""Digests of many numbers at once equal hashlib's, and the shuffle that is ordered by them needs no call per base."""

from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from helixmill.operators import digests as D, enrichment as E


@pytest.mark.parametrize("block", [7, 1000, 16_384])
def test_digests_equal_hashlib(monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    prefixes, sizes = [b"42_1_0_", b"", b"42_-9223372036854775808_2_", b"x" * 50, "42_é_".encode()], [1203, 11, 0, 5, 101]
    want = [int.from_bytes(md5(p + b"%d" % n).digest()[:8], "big") for p, size in zip(prefixes, sizes) for n in range(size)]
    assert D.numbered_digests(prefixes, sizes).tolist() == want
    with pytest.raises(ValueError):
        D.numbered_digests([b"x" * 54], [100])


def test_shuffles_are_the_same_without_a_call_per_base(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTN"), n)) for n in (0, 1, 2, 999, 70_000)] + [None, "éAC", "ACGT" * 9]
    salts = [f"42_{n}_1_" for n in range(7)] + ["s" * 60]
    want = [text and E._mixed(text, salt) for text, salt in zip(texts, salts)]
    called, plain = [], E._mixed
    monkeypatch.setattr(E, "_mixed", lambda text, salt: called.append(text) or plain(text, salt))
    found = E._mixed_texts.func(pd.Series(texts, dtype=object), pd.Series(salts)).tolist()
    assert [x if isinstance(x, str) else None for x in found] == want
    assert called == ["éAC", "ACGT" * 9]  # only those that have no other way
