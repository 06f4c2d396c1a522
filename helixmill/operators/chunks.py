"""Cutting sequences into independent work units.

A chunk row is (core, right context). Cores tile the sequence and are cut only at *clean*
positions, i.e. where no locally found motif can reach across: there is no G pair within loop
distance, no AAA/CCC/GGG/TTT next to the cut, the two bases belong to no common tract alphabet,
no scored 10-mer, tandem run or phased A-tract touches it. Scans of a core are therefore exactly
the scans of the whole sequence, whatever the chunk length, and any later window over local
motifs can be keyed by (seq_id, chunk_start), a bounded group, instead of by chromosome.
Pairing scans (repeat arms, extension zones) look right into the context.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill import tables as T
from helixmill.operators import kernels as K

CHUNK_LEN = 100_000
CONTEXT = T.CHUNK_CONTEXT
FLUSH_BYTES = 8 << 20

CHUNK_SCHEMA = (
    "seq_id bigint, seq_name string, seq_len bigint, chunk_start bigint, chunk_end bigint, reach bigint, text string"
)

# a cut needs a purine next to a pyrimidine, one of them G or C
_BORDER = re.compile("(?<=[AG])C|(?<=[CT])G|(?<=C)A|(?<=G)T")
_TRIPLET = re.compile("AAA|CCC|GGG|TTT")


def _is_clean(text: str, cut: int) -> bool:
    if "GG" in text[max(0, cut - 13) : cut + 13] or _TRIPLET.search(text, max(0, cut - 8), cut + 8):
        return False
    lo = max(0, cut - 40)
    raw = K.to_bytes(text[lo : cut + 40])
    at = cut - lo
    for hits, _ in (K.z_tenmers(raw), K.a_philic_tenmers(raw)):
        if ((hits >= at - 10) & (hits <= at)).any():
            return False
    for unit in T.STR_UNITS:
        for start, copies in K.tandem_repeats(raw, unit):
            if start < at < start + copies * unit + unit:
                return False
    lo, hi = max(0, cut - 600), min(len(text), cut + 600)
    for start, end, _, _, centre in K.at_windows(text, lo, hi):
        if end - start >= 100 and (start == lo or end == hi):
            return False
        if centre is not None and abs(centre - cut) <= 24:
            return False
    return True


def clean_cut(text: str, at: int) -> int:
    """The first clean position at or after ``at``; the sequence end if there is none."""
    for m in _BORDER.finditer(text, at):
        if _is_clean(text, m.start()):
            return m.start()
    return len(text)


def cut_points(text: str, chunk_len: int) -> list[int]:
    cuts = [0]
    while len(text) - cuts[-1] > chunk_len * 3 // 2:
        cuts.append(clean_cut(text, cuts[-1] + chunk_len))
    if cuts[-1] < len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return cuts


def _long_palindromes(text: str, probe: int = 24, step: int = 1024) -> list[tuple[int, int, int]]:
    """(leftmost, innermost, mirror sum) of paired stretches longer than the default context.

    The innermost probe of such a stretch finds its partner within a short look-ahead, so one
    substring search per ``step`` bases is enough; the stretch is then followed outwards.
    """
    found = []
    if len(text) <= CONTEXT:
        return found
    raw = K.to_bytes(text)
    for complement in (True, False):
        other = K._COMPLEMENT[raw] if complement else raw
        reach = -1
        for at in range(0, len(text) - probe, step):
            word = text[at : at + probe]
            if at < reach or set(word) == {"N"}:
                continue
            want = K.revcomp(word) if complement else word[::-1]
            hit = text.find(want, at + probe, at + 2 * step + 2 * probe + T.INVERTED_MAX_LOOP)
            if hit < 0:
                continue
            total = at + hit + probe - 1
            left = at
            while left > 0 and total - left + 1 < len(text):
                block = min(4096, left, len(text) - 1 - (total - left))
                if block <= 0:
                    break
                mine = raw[left - block : left][::-1]
                theirs = other[total - left + 1 : total - left + 1 + block]
                miss = np.flatnonzero(mine != theirs)
                left -= int(miss[0]) if len(miss) else block
                if len(miss):
                    break
            if total - 2 * left > CONTEXT // 2:
                found.append((left, at + probe, total))
                reach = at + probe
    return found


def cut_sequence(bases: str, chunk_len: int, context: int):
    """(core start, core end, reach, text) of each chunk of one sequence.

    ``reach`` is how far a pair found in an earlier chunk may extend into this one: the default
    context, or the end of the furthest long palindrome that begins before the chunk.
    """
    points = cut_points(bases, chunk_len)
    far = _long_palindromes(bases) if len(points) > 2 else ()
    for start, end in zip(points, points[1:]):
        stop = end + context
        for leftmost, inner, total in far:
            if leftmost < end and inner > start:
                stop = max(stop, total - max(leftmost, start) + 1)
        reach = max([context, *(total - leftmost + 1 - start for leftmost, _, total in far if leftmost < start)])
        yield start, end, reach, bases[start:stop]


def chunk_sequences(sequences: DataFrame, chunk_len: int = CHUNK_LEN, context: int = CONTEXT) -> DataFrame:
    """(seq_id, seq_name, bases) -> chunk rows. Narrow: no shuffle, one row in, n rows out.

    Scans cut plain sequences by themselves; this form is for spreading few giant sequences with
    ``chunk_sequences(...).repartition(...)``: every chunk row carries all it needs.
    """

    def cut(batches):
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_CHUNK_FIELDS)

        rows, held = [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                seq_id, name, bases = (c[n].as_py() for c in batch.columns)
                for piece in cut_sequence(bases, chunk_len, context):
                    rows.append((seq_id, name, len(bases), *piece))
                    held += len(piece[3])
                    if held >= FLUSH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
        if rows:
            yield packed(rows)

    return sequences.select("seq_id", "seq_name", "bases").mapInArrow(cut, CHUNK_SCHEMA)


_CHUNK_FIELDS = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
