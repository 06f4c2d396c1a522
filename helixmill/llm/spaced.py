"""Texts of an Arrow block as words with their leading white space, each different word once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixmill.llm.text import flat_utf8

BLANK, LINE_FEED = 32, 10
ASCII_SPACE = np.isin(np.arange(128), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: UTF-8 of the white space beyond ASCII
WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
TWO = [int.from_bytes(c, "big") for c in WIDE_SPACE if len(c) == 2]
THREE = [int.from_bytes(c, "big") for c in WIDE_SPACE if len(c) == 3]


def gather(parts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts (end to end, with their sizes) in the order and as often as ``which`` names them."""
    width = parts.dtype.itemsize
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) * width
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(parts))])
    data = held.take(pa.array(which)).buffers()[2]
    return np.frombuffer(data, parts.dtype) if data is not None else np.zeros(0, parts.dtype)


class SpacedWords:
    """``distinct`` words, ``which`` of them stands at each place, and where the words of each text begin (``at``).

    Every non-empty text gets a blank before it and is cut before each blank or line feed that
    follows a sign which is not white space. No byte is lost: the words of a text joined are the
    blank and the text. Empty and null texts have no words.
    """

    def __init__(self, texts: pa.Array):
        whole = pc.fill_null(texts, "").cast(pa.large_string())
        blank, nothing = (pa.scalar(v, pa.large_string()) for v in (" ", ""))
        led = pc.if_else(pc.equal(pc.binary_length(whole), 0), whole, pc.binary_join_element_wise(blank, whole, nothing))
        data, bounds = flat_utf8(led)
        gap = np.flatnonzero((data == BLANK) | (data == LINE_FEED))
        gap = gap[gap > 0]
        before = data[gap - 1]
        cut = before >= 128
        cut[~cut] = ~ASCII_SPACE[before[~cut]]
        wide = np.flatnonzero(before >= 128)
        place = gap[wide]
        low, mid, high = (data[np.maximum(place - n, 0)].astype(np.int64) for n in (1, 2, 3))
        cut[wide] = ~(np.isin(mid << 8 | low, TWO) | np.isin(high << 16 | mid << 8 | low, THREE))
        begins = np.zeros(len(data), bool)
        begins[gap[cut]] = True
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(begins)
        self.at = np.searchsorted(starts, bounds)
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.which = coded.indices.to_numpy(zero_copy_only=False)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of a value of each different word over its places."""
        running = np.concatenate(([0], np.cumsum(values[self.which], dtype=np.int64)))
        return running[self.at[1:]] - running[self.at[:-1]]
