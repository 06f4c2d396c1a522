"""Words of whole blocks of texts as 64-bit hashes, with array operations only."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
SIGN_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: everything in ASCII but letters and digits
NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class _Powers:
    """Powers of STEP and of its inverse modulo 2**64, kept for the longest block so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 1 << 16)
            for name, step in (("up", STEP), ("down", INVERSE)):
                values = np.full(size, step)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


POWERS = _Powers()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and the last text's end.

    A-Z count as a-z; any other byte but a separator belongs to a word. A word never crosses texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    POWERS.upto(n)
    inside = ~separators[data]
    heads = np.zeros(n + 1, bool)
    heads[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | heads[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | heads[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(SIGN_VALUES[LOWER[data]] * POWERS.up[:n], out=running[1:])
    hashes = mix((running[ends] - running[begins]) * POWERS.down[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, offsets)
