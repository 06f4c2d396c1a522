"""One narrow pass over chunk rows that finds the candidates of all requested detectors.

Each detector contributes a short generator that yields candidate tuples; scoring, gating and
overlap resolution happen on the resulting DataFrame. Reading every chunk once for nine
detectors is what makes the whole pipeline a single scan of the input.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from helixmill import catalogs, tables as T
from helixmill.operators import kernels as K
from helixmill.operators.chunks import CHUNK_LEN, CONTEXT, cut_sequence
from helixmill.operators.overlap import fates, open_zone
from helixmill.operators.plugins import pattern_rows

CANDIDATE_SCHEMA = (
    "seq_id bigint, seq_name string, seq_len bigint, chunk_start bigint, chunk_end bigint, "
    "det int, family string, emit bigint, seen bigint, start bigint, end bigint, seq string, "
    "unit int, copies int, arm int, loop int, n_hits int, raw double, centers array<double>, "
    "rez_start bigint, rez_end bigint, rez_pct double, far bigint"
)
_FIELDS = [f.split()[0] for f in CANDIDATE_SCHEMA.split(", ")]
_OWN = _FIELDS[6:]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_ARROW_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in CANDIDATE_SCHEMA.split(", ")])

_LONG_A, _LONG_T = re.compile("A{%d,}" % T.LONG_TRACT), re.compile("T{%d,}" % T.LONG_TRACT)
_RIZ = [(family, re.compile(regex)) for family, regex, *_ in catalogs.RIZ]
_G4 = [(family, re.compile(regex)) for family, regex, *_ in catalogs.G4_FAMILIES]
_G4_ON_PAIRS = {"relaxed_g4", "bulged_g4", "imperfect_g4"}
_CANONICAL_I = re.compile(catalogs.CANONICAL_I_MOTIF[1])
_HUR = [(linker, re.compile(regex)) for _, linker, regex in catalogs.hur_patterns()]


class Chunk:
    """The text of one chunk row and the arrays derived from it."""

    group, number = None, 0
    only = None  # detectors to run on this chunk, where not all are wanted

    def __init__(self, text, n_core, lo=0, seq_len=None, reach=0, first=None, every=True):
        self.every = every  # list every hit, or only those that can still be selected
        self.text, self.n_core, self.reach = text, n_core, reach
        self.first = first or (lambda word: lo + text.find(word))  # first place of a word in the sequence
        self.lo, self.seq_len = lo, n_core if seq_len is None else seq_len
        self.core = text[:n_core]
        self.raw = K.to_bytes(text)
        self.raw_core = self.raw[:n_core]

    def contenders(self, start, end, order, reach):
        """Rows that win inside this chunk or may still meet a row of a neighbouring chunk.

        Pairing scans list many overlapping hits per position; the losers stay here instead of
        travelling with their text.
        """
        ranked = np.lexsort(tuple(order)[::-1])
        zone = open_zone(self.lo, self.lo + self.n_core, self.seq_len, reach)
        spans = zip((start[ranked] + self.lo).tolist(), (end[ranked] + self.lo).tolist())
        fate = np.fromiter(fates(spans, *zone), np.int8, len(ranked))
        return np.sort(ranked[fate > 0])

    def slice(self, start, end):
        return self.text[start:end]

    def rows(self, finder, places):
        """Rows of ``finder(raw, n_core)``, whose columns ``places`` are positions; a group makes one call for all."""
        if self.group is None:
            return finder(self.raw, self.n_core)
        return self.group.rows(finder, places, self.number)


GROUP_LEN, GROUP_LEAST = 1 << 17, 16
_GAP = max(T.INVERTED_SEED + T.INVERTED_MAX_LOOP, T.MIRROR_SEED + T.MIRROR_MAX_LOOP) + 1


class Group:
    """Short whole sequences laid out in one array, so that a kernel is called once for all of them.

    Gaps are wider than two arms can be apart and hold one of 128 values that no text has, in turn:
    a comparison that runs into a gap ends there, and no pair crosses one.
    """

    def __init__(self, chunks):
        self.starts, parts, at = [], [], 0
        for number, chunk in enumerate(chunks):
            chunk.group, chunk.number = self, number
            gap = np.full(_GAP, 128 + number % 128, np.uint8)
            self.starts.append(at)
            parts += [chunk.raw, gap]
            at += len(chunk.raw) + _GAP
        self.raw, self.starts, self.chunks = np.concatenate(parts), np.array(self.starts), chunks
        self.found = {}

    def rows(self, finder, places, number):
        if finder not in self.found:
            found = finder(self.raw, len(self.raw))
            cuts = np.searchsorted(found[:, 0], self.starts).tolist() + [len(found)]
            found[:, places] -= np.repeat(self.starts, np.diff(cuts))[:, None]
            self.found[finder] = found, cuts
        found, cuts = self.found[finder]
        return found[cuts[number] : cuts[number + 1]]


def _grouped(chunks):
    """The chunks in their order; short whole sequences next to each other share a group."""
    held, size = [], 0
    for head, chunk in chunks:
        alone = chunk.n_core < chunk.seq_len or not GROUP_LEAST <= len(chunk.raw) <= GROUP_LEN // 4
        if held and (alone or size >= GROUP_LEN or chunk.only != held[-1][1].only):
            Group([c for _, c in held])
            yield from held
            held, size = [], 0
        if alone:
            yield head, chunk
        else:
            held.append((head, chunk))
            size += len(chunk.raw)
    if held:
        Group([c for _, c in held])
        yield from held


def _candidate(family, start, end, **own):
    return {"family": family, "start": start, "end": end, **own}


def _curved(c: Chunk):
    centres = K.at_centres(c.core)
    # the tolerance is asymmetric, so the larger deviation scales the score
    allowed = max(abs(T.PHASE_HIGH - T.PHASE_IDEAL), abs(T.PHASE_IDEAL - T.PHASE_LOW))
    for run in K.phased_runs(centres):
        deviation = float(np.abs(np.diff(run) - T.PHASE_IDEAL).mean())
        start, end = K.phased_span(run, c.n_core)
        yield _candidate("APR", start, end, raw=round(max(0.0, 1.0 - deviation / allowed), 6), centers=run)
    tracts = [m.span() for pattern in (_LONG_A, _LONG_T) for m in pattern.finditer(c.core)]
    for start, end in sorted(tracts):
        yield _candidate("TRACT", start, end)


def _tandem(raw, n_core):
    """(start, unit, copies) of the tandem blocks of all unit lengths, by start."""
    found = [(start, unit, copies) for unit in T.STR_UNITS for start, copies in K.tandem_repeats(raw[:n_core], unit)]
    found = np.array(found, np.int64).reshape(-1, 3)
    found = found[raw[found[:, 0]] < 128]  # not the gaps of a group
    return found[np.argsort(found[:, 0], kind="stable")]


def _slipped(c: Chunk):
    found = []
    for start, unit, copies in c.rows(_tandem, [0]).tolist():
        found.append((start, _candidate("STR", start, start + unit * copies, unit=unit, copies=copies)))
    left, unit, spacer = c.rows(K.direct_repeats, [0]).T
    if len(left):
        end = left + 2 * unit + spacer
        score = np.round(np.minimum(unit / 30.0, 0.95), 3)
        keep = c.contenders(left + 1, end, (-score, left - end), T.REACH[T.SLIPPED])
        for left, unit, spacer in zip(*(x[keep].tolist() for x in (left, unit, spacer))):
            found.append((left, _candidate("DIRECT", left, left + 2 * unit + spacer, unit=unit, loop=spacer)))
    for _, row in sorted(found, key=lambda x: x[0]):
        if row["family"] == "STR":
            row["raw"] = K.tandem_score(c.slice(row["start"], row["start"] + row["unit"]), row["copies"])
        yield row


def _inverted(raw, n_core):
    return K.paired_arms(raw, T.INVERTED_SEED, T.INVERTED_MAX_LOOP, n_core, complement=True)


def _mirrored(raw, n_core):
    k = T.MIRROR_SEED
    pure = K.nearly_pure(raw, b"AG", T.MIRROR_PURITY, k) | K.nearly_pure(raw, b"CT", T.MIRROR_PURITY, k)
    return K.paired_arms(raw, k, T.MIRROR_MAX_LOOP, n_core, complement=False, inside=pure)


def _cruciform(c: Chunk):
    left, right, arm, _ = c.rows(_inverted, [0, 1]).T
    loop, end = right - left - arm, right + arm
    score = np.round(arm / (arm + 8.0) * (1.0 - loop / T.INVERTED_MAX_LOOP), 6)
    strong = score > T.CRUCIFORM_GATE
    left, end, arm, loop, score = (x[strong] for x in (left, end, arm, loop, score))
    keep = c.contenders(left, end, (-score, left - end, left), max(c.reach, T.REACH[T.CRUCIFORM]))
    for start, end, arm, loop in zip(*(x[keep].tolist() for x in (left, end, arm, loop))):
        yield _candidate("INVERTED", start, end, arm=arm, loop=loop)


def _r_loop(c: Chunk):
    triples = K.islands(K.tract_starts(c.raw_core, b"G", 3), 3, 16, 9)
    if not triples:
        return
    g_before = np.concatenate(([0], np.cumsum(c.raw == ord("G"))))
    for family, pattern in _RIZ:
        for start, end in K.spans(pattern, c.core, triples):
            share = float(K.percent(g_before[end] - g_before[start], end - start))
            if share < T.RIZ_MIN_G:
                continue
            zone = K.extension_zone(g_before, end, len(c.text))
            extra = {} if zone is None else {"rez_start": zone[0], "rez_end": zone[1], "rez_pct": zone[2]}
            yield _candidate(family, start, zone[1] if zone else end, raw=share, unit=end - start, **extra)


def _triplex(c: Chunk):
    k = T.MIRROR_SEED
    rows = c.rows(_mirrored, [0, 1, 3])
    if len(rows):
        purine = np.concatenate(([0], np.cumsum(K.one_of(c.raw, b"AG"))))
        pyrimidine = np.concatenate(([0], np.cumsum(K.one_of(c.raw, b"CT"))))
        left, right, arm, first_right = rows.T
        shares = [
            (side[left + arm] - side[left] + side[right + arm] - side[right]) / (2 * arm)
            for side in (purine, pyrimidine)
        ]
        pure = np.flatnonzero((shares[0] >= T.MIRROR_PURITY) | (shares[1] >= T.MIRROR_PURITY))
        # hits arrive in the order in which their seed words are first met
        places, nth = np.unique(left[pure], return_inverse=True)
        met = np.array([c.first(c.text[i : i + k]) for i in places.tolist()], np.int64)
        seen = dict(zip(places.tolist(), met.tolist()))
        ranked = pure[np.lexsort((first_right[pure], left[pure], met[nth]))]
        end = right + arm
        if not c.every:
            rank = np.arange(len(ranked))
            ranked = ranked[c.contenders(left[ranked], end[ranked], (rank,), max(c.reach, T.REACH[T.TRIPLEX]))]
        counts = purine[end] - purine[left], pyrimidine[end] - pyrimidine[left]
        for r in ranked.tolist():
            i, j, a = int(left[r]), int(right[r]), int(arm[r])
            family = "Homopurine mirror repeat" if round(shares[0][r], 3) >= T.MIRROR_PURITY else "Homopyrimidine mirror repeat"
            own = {"unit": int(counts[0][r]), "copies": int(counts[1][r])}  # purines and pyrimidines of the span
            yield _candidate(family, i, j + a, arm=a, loop=j - i - a, seen=seen[i], raw=0.0, **own)
    for name, pattern, word in _STICKY:
        for start, end in K.spans(pattern, c.core) if word in c.core else ():
            yield _candidate(name, start, end, seen=c.lo + start, raw=1.0)


def _g_quadruplex(c: Chunk):
    pairs = K.islands(K.tract_starts(c.raw_core, b"G", 2), 2, 24, T.MIN_REGION)
    if not pairs:
        return
    triples = K.islands(K.tract_starts(c.raw_core, b"G", 3), 3, 24, T.MIN_REGION)
    for rank, (family, pattern) in enumerate(_G4):
        for start, end in K.spans(pattern, c.core, pairs if family in _G4_ON_PAIRS else triples):
            if end - start >= T.MIN_REGION:
                yield _candidate(family, start, end)


def _i_motif(c: Chunk):
    n = c.n_core
    found = []

    def anchors(raw, letters):
        return np.unique(np.concatenate([K.tract_starts(raw, letter, 3) for letter in letters]))

    strands = [("+", c.core, K.islands(anchors(c.raw_core, (b"A", b"C")), 3, 12, 24))]
    reverse_anchor = anchors(c.raw_core, (b"T", b"G"))
    if len(reverse_anchor):
        mirrored = np.sort(n - 3 - reverse_anchor)
        where = K.islands(mirrored, 3, 12, 24)
        if where:
            strands.append(("-", K.revcomp(c.core), where))
    for strand, text, where in strands:
        for linker, pattern in _HUR:
            for s, e in K.spans(pattern, text, where):
                start, end = (s, e) if strand == "+" else (n - e, n - s)
                found.append(_candidate("ac_motif_hur", start, end, unit=linker, seq=text[s:e]))
    yield from sorted(found, key=lambda row: row["start"])
    for s, e in K.spans(_CANONICAL_I, c.core, K.islands(K.tract_starts(c.raw_core, b"C", 3), 3, 12, T.MIN_REGION)):
        yield _candidate("canonical_imotif", s, e)
    for linker, pattern in _HUR:
        for s, e in K.spans(pattern, c.core, strands[0][2]):
            yield _candidate("hur_ac_motif", s, e, unit=linker)


def _regions(family, finder):
    def scan(c: Chunk):
        for start, end, n, total in K.merged_tenmers(*finder(c.raw_core)):
            yield _candidate(family, start, end, n_hits=n, raw=round(total, 6))

    return scan


SCANNERS = {
    T.CURVED: _curved,
    T.SLIPPED: _slipped,
    T.CRUCIFORM: _cruciform,
    T.R_LOOP: _r_loop,
    T.TRIPLEX: _triplex,
    T.G4: _g_quadruplex,
    T.I_MOTIF: _i_motif,
    T.Z_DNA: _regions("Z", K.z_tenmers),
    T.A_PHILIC: _regions("A", K.a_philic_tenmers),
}


FLUSH_BYTES = 8 << 20
_ROW_BYTES, _SLICE = 200, 128


def python_rows(batch):
    """The rows of an Arrow batch, of which only a slice is held as Python objects."""
    for lo in range(0, batch.num_rows, _SLICE):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, _SLICE).columns))


def pieces(batch, chunk_len=CHUNK_LEN):
    """Chunk rows of a batch of sequences or of chunk rows, with a search in the whole sequence where it is at hand."""
    rows = python_rows(batch)
    if batch.num_columns > 3:
        for seq_id, name, seq_len, lo, hi, reach, text in rows:
            yield seq_id, name, seq_len, lo, hi, reach, text, None
        return
    for seq_id, name, bases in rows:
        first = lru_cache(None)(bases.find)
        for lo, hi, reach, text in cut_sequence(bases, chunk_len, CONTEXT):
            yield seq_id, name, len(bases), lo, hi, reach, text, first


def _chunks(batch, chunk_len, every):
    for seq_id, name, seq_len, lo, hi, reach, text, first in pieces(batch, chunk_len):
        yield (seq_id, name, seq_len, lo, hi, reach), Chunk(text, hi - lo, lo, seq_len, reach, first, every)


def _candidate_batches(chunks, detectors, text, schema):
    """Arrow batches of the candidates in (head, chunk) pairs; a head holds the first five fields, the reach and
    what ``schema`` has behind the candidate fields."""
    rows, held = [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    for (seq_id, name, seq_len, lo, hi, reach, *more), chunk in chunks:
        for det in chunk.only or detectors:
            for emit, row in enumerate(SCANNERS[det](chunk)):
                if "seq" not in row and (text or "arm" not in row):
                    row["seq"] = chunk.slice(row["start"], row["end"])
                for key in ("start", "end", "rez_start", "rez_end"):
                    if key in row:
                        row[key] += lo
                if "centers" in row:
                    row["centers"] = (row["centers"] + lo).tolist()
                row["emit"], row["far"] = emit, reach
                rows.append((seq_id, name, seq_len, lo, hi, det, *map(row.get, _OWN), *more))
                held += len(row.get("seq", "")) + _ROW_BYTES
                if held >= FLUSH_BYTES:
                    yield packed()
                    rows, held = [], 0
    yield packed()


def scan_candidates(
    source: DataFrame, detectors=tuple(SCANNERS), chunk_len: int | None = None, every: bool = True, text: bool = True
) -> DataFrame:
    """Candidate rows of the given detectors (numbers from ``tables``), 0-based half-open.

    ``source`` holds sequences, which are cut on the fly, or chunk rows. Without ``every``, triplex arms
    that are beaten for certain inside their chunk are left out; without ``text``, ``seq`` is null
    for arms, whose scores need none: low-complexity text has hits by the square of its length.
    """
    if "text" not in source.columns:
        source = source.select("seq_id", "seq_name", "bases")
    chunk_len = chunk_len or CHUNK_LEN

    def run(batches):
        chunks = (pair for batch in batches for pair in _grouped(_chunks(batch, chunk_len, every)))
        return _candidate_batches(chunks, detectors, text, _ARROW_SCHEMA)

    return source.mapInArrow(run, CANDIDATE_SCHEMA)


PACK_LEN = 16_384
_PACK_SCHEMA = "seq_id bigint, seq_name string, seq_len bigint, seed int, lo bigint, text string, starts array<bigint>, ends array<bigint>"
_WINDOW_FIELDS = "origin bigint, seed int, seed_start bigint, seed_end bigint, window_start bigint"
_ARROW["array<bigint>"] = pa.list_(pa.int64())
_PACK_ARROW, _WINDOW_ARROW = (pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in x.split(", ")]) for x in (_PACK_SCHEMA, f"{CANDIDATE_SCHEMA}, {_WINDOW_FIELDS}"))


def _window(start, end, seq_len, size):
    return max(0, start - size), min(seq_len, end + size)


def seed_packs(sequences: DataFrame, seeds: list[tuple]) -> DataFrame:
    """Seed matches (0-based half-open) with the text of the windows around them, ``seeds`` being (detector, regex, window size).

    Windows overlap many times over. A row holds neighbouring matches of one seed and the stretch that their windows
    share, at most ``PACK_LEN`` long or one window, so that text travels about once per seed. Sequences are read whole, as catalog scans do.
    """

    def run(batches):
        compiled = [(n, size, matcher(rx)) for n, (_, rx, size) in enumerate(seeds)]
        rows, held = [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACK_ARROW)], schema=_PACK_ARROW)

        def packs(spans, seq_len, size):
            pack, lo, hi = [], 0, 0
            for span in spans:
                begin, stop = _window(*span, seq_len, size)
                if pack and max(hi, stop) - lo > PACK_LEN:
                    yield lo, hi, pack
                    pack = []
                if not pack:
                    lo, hi = begin, stop
                pack.append(span)
                hi = max(hi, stop)
            if pack:
                yield lo, hi, pack

        for batch in batches:
            for seq_id, name, bases in python_rows(batch):
                for seed, size, find in compiled:
                    for lo, hi, pack in packs(find(bases), len(bases), size):
                        rows.append((seq_id, name, len(bases), seed, lo, bases[lo:hi], *map(list, zip(*pack))))
                        held += hi - lo + 16 * len(pack) + _ROW_BYTES
                        if held >= FLUSH_BYTES:
                            yield packed()
                            rows, held = [], 0
        if rows:
            yield packed()

    return sequences.select("seq_id", "seq_name", "bases").mapInArrow(run, _PACK_SCHEMA)


def scan_seed_windows(packs: DataFrame, seeds: list[tuple], chunk_len: int | None = None) -> DataFrame:
    """Candidates of each seed's detector in the windows of ``seed_packs``, in coordinates of the window.

    ``seq_id`` numbers the windows; ``origin`` is the sequence. Rows of a window are adjacent.
    """
    chunk_len = chunk_len or CHUNK_LEN

    def windows(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:  # windows of one detector next to each other share kernel calls
            for part in pa.Table.from_batches([batch]).sort_by("seed").combine_chunks().to_batches():
                for seq_id, name, seq_len, seed, lo, text, starts, ends in python_rows(part):
                    det, _, size = seeds[seed]
                    for start, end in zip(starts, ends):
                        begin, stop = _window(start, end, seq_len, size)
                        bases = text[begin - lo : stop - lo]
                        number += 1
                        for core, upto, reach, piece in cut_sequence(bases, chunk_len, CONTEXT):
                            chunk = Chunk(piece, upto - core, core, len(bases), reach, lru_cache(None)(bases.find) if core else None, False)
                            chunk.only = (det,)
                            yield (number, name, len(bases), core, upto, reach, seq_id, seed, start + 1, end, begin), chunk

    def run(batches):
        return _candidate_batches(_grouped(windows(batches)), (), True, _WINDOW_ARROW)

    return packs.mapInArrow(run, f"{CANDIDATE_SCHEMA}, {_WINDOW_FIELDS}")


_SPACED = re.compile(r"^\(\[ATGC\]\{(\d+),(\d*)\}\)\(\?:\[ATGC\]\{0,(\d+)\}\)\\1$")
_TANDEM = re.compile(r"^\(\[(?:ATGC|ACGT)\](?:\{(?:(\d+),)?(\d+)\})?\)\\1\{(\d+),\}$")
_LETTERS = re.compile("[ATGC]+")


def needles(regex: str) -> list[tuple[str, ...]]:
    """Words of at least six letters that every match of ``regex`` holds, in upper case: one of each tuple."""

    def walk(items):
        held, word = [], ""
        for kind, value in items:
            body = value[-1] if kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.SUBPATTERN) else None
            if kind is _parser.LITERAL:
                word += chr(value)
                continue
            if kind is _parser.SUBPATTERN and all(k is _parser.LITERAL for k, _ in body):
                word += "".join(chr(x) for _, x in body)
                continue
            if kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
                least, most, _ = value
                body = body[0][1][-1] if len(body) == 1 and body[0][0] is _parser.SUBPATTERN else body
                if all(k is _parser.LITERAL for k, _ in body):
                    copies = "".join(chr(x) for _, x in body) * least
                    word += copies
                    if most != least:
                        held, word = [*held, (word,)], copies
                    continue
                held, word = [*held, (word,), *(walk(body) if least else [])], ""
                continue
            held, word = [*held, (word,)], ""
            if kind is _parser.SUBPATTERN:
                held += walk(body)
            elif kind is _parser.BRANCH:
                best = [max((c for c in walk(arm) if len(c) == 1), key=lambda c: len(c[0]), default=("",)) for arm in value[1]]
                held.append(tuple(c[0] for c in best))
        return [*held, (word,)]

    return list(dict.fromkeys(tuple(x.upper() for x in clause) for clause in walk(_parser.parse(regex)) if all(len(x) >= 6 for x in clause)))


_STICKY = [(name, re.compile(regex), needles(regex)[0][0]) for name, regex, *_ in catalogs.STICKY]


def matcher(regex: str):
    """bases -> spans. Spaced and tandem back-references would backtrack and get their own search; texts
    without a word that every match holds are not searched."""
    spaced, tandem = _SPACED.match(regex), _TANDEM.match(regex)
    if not spaced and not tandem:
        pattern, wanted = re.compile(regex, re.I | re.A), needles(regex)

        def plain(bases):
            upper = bases.upper() if wanted else ""
            if all(any(x in upper for x in clause) for clause in wanted):
                return [m.span() for m in pattern.finditer(bases)]
            return []

        return plain
    if tandem:
        most, more = int(tandem[2] or 1), int(tandem[3])
        units = range(int(tandem[1] or most), most + 1)

        def find(raw):
            return K.tandem_spans(raw, units, more)
    else:
        least, most, gap = (int(x) if x else None for x in spaced.groups())

        def find(raw):
            return K.spaced_repeats(raw, least, most, gap)

    def search(bases):
        out = []
        for run in _LETTERS.finditer(bases):
            s = run.start()
            out += [(s + a, s + b) for a, b in find(K.to_bytes(run.group()))]
        return out

    return search


def scan_patterns(sequences: DataFrame, patterns: DataFrame | list[tuple]) -> DataFrame:
    """Leftmost non-overlapping matches of a catalog over whole sequences.

    ``patterns`` are (class, pattern_id, subclass, regex) rows, as a list or as a catalog table, a
    few dozen at most; they travel with the task closure. Catalog regexes may look arbitrarily far (back-references, unbounded
    classes), so the unit of work is one sequence. Returns 1-based inclusive coordinates.
    """
    patterns = pattern_rows(patterns)
    schema = (
        "seq_id bigint, seq_name string, seq_len bigint, ord int, class string, pattern_id string, "
        "subclass string, start bigint, end bigint, sequence string"
    )

    def run(batches):
        compiled = [(n, cls, pid, sub, matcher(rx)) for n, (cls, pid, sub, rx) in enumerate(patterns)]
        names, kinds = [f.split()[0] for f in schema.split(", ")], [_ARROW[f.split()[1]] for f in schema.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

        out, held = [], 0
        for batch in batches:
            for seq_id, name, bases in python_rows(batch):
                for n, cls, pid, sub, find in compiled:
                    for s, e in find(bases):
                        out.append((seq_id, name, len(bases), n, cls, pid, sub, s + 1, e, bases[s:e]))
                        held += e - s + _ROW_BYTES
                        if held >= FLUSH_BYTES:
                            yield packed(out)
                            out, held = [], 0
        if out:
            yield packed(out)

    return sequences.select("seq_id", "seq_name", "bases").mapInArrow(run, schema)
