"""md5 of a prefix and a running number, for many numbers at once.

A message of at most 55 bytes is one block, so its md5 is 64 steps on four words; numpy takes them for a block of
messages at a time, which costs about a sixth of one ``hashlib`` call per message.
"""

from __future__ import annotations

from math import floor, sin

import numpy as np

BLOCK, LONGEST = 16_384, 55
_ADD = [np.uint32(floor(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [s for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turns * 4]
_PLACE = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_words(words: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of one-block messages given as their sixteen words, None for zero."""
    n = len(words[14])
    a, b, c, d = (np.full(n, x) for x in _BEGIN)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += _ADD[i]
        if words[_PLACE[i]] is not None:
            t += words[_PLACE[i]]
        np.left_shift(t, np.uint32(_TURN[i]), out=u)
        t >>= np.uint32(32 - _TURN[i])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += _BEGIN[0]
    b += _BEGIN[1]
    return a, b


def _pieces(prefixes: list[bytes], sizes: list[int]):
    """(place, prefix, first number, one behind the last, digits): numbers of one prefix with equally many digits, at most BLOCK."""
    place = 0
    for prefix, size in zip(prefixes, sizes):
        lo = 0
        while lo < size:
            digits = len(str(lo))
            hi = min(size, 10**digits, lo + BLOCK)
            yield place + lo, prefix, lo, hi, digits
            lo = hi
        place += size


def numbered_digests(prefixes: list[bytes], sizes: list[int]) -> np.ndarray:
    """The first eight bytes, as a big-endian number, of the md5 of each prefix followed by 0, 1, ... size - 1."""
    if max(map(len, prefixes)) + len(str(max(sizes))) > LONGEST:
        raise ValueError(f"messages have at most {LONGEST} bytes")
    out = np.empty(sum(sizes), np.uint64)
    held, used, first, rows = np.zeros((16, BLOCK), np.uint32), np.zeros(16, bool), 0, 0

    def flush():
        a, b = _first_words([row[:rows] if some else None for row, some in zip(held, used)])
        out[first : first + rows] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()

    for place, prefix, lo, hi, digits in _pieces(prefixes, sizes):
        if rows + hi - lo > BLOCK:
            flush()
            used[:], first, rows = False, place, 0
        size = len(prefix) + digits
        message = (prefix + b"0" * digits + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
        words = np.frombuffer(message, "<u4")
        held[used & (words == 0), rows : rows + hi - lo] = 0
        for at in np.flatnonzero(words).tolist():
            if not used[at]:
                held[at, :rows] = 0
            held[at, rows : rows + hi - lo] = words[at]
        used |= words != 0
        number = np.arange(lo, hi, dtype=np.uint64 if hi >> 32 else np.uint32)
        for at in range(size - 1, len(prefix) - 1, -1):
            rest = number // 10
            held[at // 4, rows : rows + hi - lo] += (number - rest * 10).astype(np.uint32) << np.uint32(8 * (at % 4))
            number = rest
        rows += hi - lo
    if rows:
        flush()
    return out
