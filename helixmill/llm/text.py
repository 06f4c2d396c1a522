"""Arrow batches of texts as flat numpy arrays: byte-bounded blocks, character classes, pre-token spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
OTHER, LETTER, NUMBER, SPACE, START = 0, 1, 2, 3, 255


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds at most ``limit`` bytes, or one row.

    This bounds the arrays a task holds, however many rows Spark puts into one batch.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins and the last ends. Null counts as empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@lru_cache(1)
def character_classes() -> np.ndarray:
    """For every code point whether it is a letter, a number, white space or something else."""
    import regex

    every, table = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for hit in regex.finditer(pattern, every):
            table[hit.start() : hit.end()] = kind
    return table


class Characters:
    """Code points of all texts of a block with their classes and byte positions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = (data & 0xC0) != 0x80
        self.byte_at = np.append(np.flatnonzero(heads), len(data))
        if len(self.byte_at) != len(self.points) + 1:
            raise ValueError("texts must be valid UTF-8")
        before = np.concatenate(([0], np.cumsum(heads)))
        self.bounds = before[offsets]
        self.first = np.zeros(len(self.points) + 1, bool)
        self.first[self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]] = True
        self.first[-1] = True
        self.kinds = character_classes()[self.points]

    def _starts(self) -> np.ndarray:
        before = np.empty_like(self.kinds)
        before[1:] = self.kinds[:-1]
        before[self.first[:-1]] = START
        return self.kinds != before

    def _contractions(self, start: np.ndarray) -> None:
        """An apostrophe that opens a token takes s, t, m, d, re, ve or ll with it."""
        points, n = self.points, len(self.points)
        here = np.flatnonzero((points == ord("'")) & start)
        padded, first = np.append(points, [0, 0, 0]), np.append(self.first, [True, True, True])
        one, two = padded[here + 1], padded[here + 2]
        inside = ~first[here + 1]
        single = here[inside & np.isin(one, [ord(c) for c in "stmd"])]
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double = here[inside & ~first[here + 2] & pairs]
        start[single + 1] = False
        start[double + 1] = False
        start[double + 2] = False
        after = np.concatenate((single + 2, double + 3))
        start[after[after < n]] = True

    def spans(self, attach_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every pre-token, as code point positions.

        ``attach_space``: runs of letters, numbers or other signs, each with one blank before it
        if there is one, and the white space between. Otherwise white space is dropped and each
        number sign stands alone.
        """
        n = len(self.points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = self._starts()
        if attach_space:
            space = self.kinds == SPACE
            last = space[:-1] & ~space[1:] & ~self.first[1:-1]
            start[:-1] |= last
            start[1:] &= ~(last & (self.points[:-1] == 32))
        else:
            start |= self.kinds == NUMBER
        self._contractions(start)
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], n)
        if not attach_space:
            wanted = self.kinds[begins] != SPACE
            begins, ends = begins[wanted], ends[wanted]
        return begins, ends

    def distinct(self, begins: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The different pre-tokens, and for each span which one it is."""
        lengths = self.byte_at[ends] - self.byte_at[begins]
        at = np.concatenate(([0], np.cumsum(lengths)))
        if at[-1] == len(self.data):
            data = self.data
        else:
            keep = np.zeros(len(self.data) + 1, np.int8)
            keep[self.byte_at[begins]] += 1  # no position begins two spans, none ends two
            keep[self.byte_at[ends]] -= 1
            data = self.data[np.cumsum(keep[:-1]) > 0]
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes()))
        coded = words.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)

    def per_text(self, begins: np.ndarray) -> np.ndarray:
        """Where the spans of each text begin among all spans, and where the last text's end."""
        return np.searchsorted(begins, self.bounds)
