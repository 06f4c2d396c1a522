"""Small numpy helpers that look at one chunk of bases inside a Spark task."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from math import prod

import numpy as np

from helixmill import tables as T, tenmers

_BASE = np.full(256, 4, np.uint8)
for _n, _b in enumerate(b"ACGT"):
    _BASE[_b] = _n
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _x, _y in zip(b"ACGT", b"TGCA"):
    _COMPLEMENT[_x] = _y
_RC = str.maketrans("ACGTacgt", "TGCAtgca")


def to_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


def revcomp(text: str) -> str:
    return text.translate(_RC)[::-1]


def complement(raw: np.ndarray) -> np.ndarray:
    return _COMPLEMENT[raw]


def one_of(raw: np.ndarray, letters: bytes) -> np.ndarray:
    listed = np.zeros(256, bool)
    listed[list(letters)] = True
    return listed[raw]


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open [start, end) of every maximal run of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(raw: np.ndarray, k: int, flip: str | None = None) -> np.ndarray:
    """Base-4 code of the k-mer at each position, -1 where it holds another letter.

    ``flip`` is None for the word itself, "reverse" for its mirror, "revcomp" for its reverse
    complement, so equal codes mean "this word pairs with that one".
    """
    base = _BASE[raw]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int32)
    digit = (3 - base.astype(np.int32)) if flip == "revcomp" else base.astype(np.int32)
    code = np.zeros(n, np.int32)
    for t in range(k):
        at = k - 1 - t if flip else t
        code = code * 4 + digit[at : at + n]
    bad = np.concatenate(([0], np.cumsum(base == 4)))
    code[(bad[k:] - bad[:-k])[:n] > 0] = -1
    return code


def islands(anchor: np.ndarray, width: int, max_gap: int, min_span: int) -> list[tuple[int, int]]:
    """Spans that can hold a match built of ``width``-long anchors at most ``max_gap`` apart."""
    if not len(anchor):
        return []
    breaks = np.flatnonzero(np.diff(anchor) > max_gap + width)
    first = anchor[np.concatenate(([0], breaks + 1))]
    last = anchor[np.concatenate((breaks, [len(anchor) - 1]))] + width
    keep = last - first >= min_span
    return list(zip(first[keep].tolist(), last[keep].tolist()))


def tract_starts(raw: np.ndarray, letter: bytes, width: int) -> np.ndarray:
    hit = raw == letter[0]
    for t in range(1, width):
        hit = hit[:-1] & (raw[t:] == letter[0])[: len(hit) - 1]
    return np.flatnonzero(hit)


def spans(pattern: re.Pattern, text: str, where=None) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, optionally only inside independent spans."""
    if where is None:
        return [m.span() for m in pattern.finditer(text)]
    return [m.span() for s, e in where for m in pattern.finditer(text, s, e)]


# --- A-tracts -------------------------------------------------------------------------------
_AT_WINDOW = re.compile("[AT]{%d,}" % T.MIN_AT_TRACT)
_AT_BLOCK = re.compile("A+T*|T+")


def at_window_profile(window: str) -> tuple[int, int, int]:
    """(longest A/AnTn run, index of its last base, longest T-only run) of one A/T window.

    A window is a row of A^a T^b blocks; T's keep extending an A run until they outnumber it.
    """
    best, best_end, best_t, offset = 0, 0, 0, 0
    for block in _AT_BLOCK.findall(window):
        a = len(block) - len(block.lstrip("A"))
        t = len(block) - a
        paired = a + min(a, t)
        if paired > best:
            best, best_end = paired, offset + paired - 1
        best_t = max(best_t, t - a)
        offset += len(block)
    return best, best_end, best_t


def _window_call(window: str):
    """Forward profile, reverse profile and the centre's offset, or None, of one A/T window."""
    f_len, f_end, f_t = at_window_profile(window)
    r_len, r_end, r_t = at_window_profile(revcomp(window))
    centre = None
    if max(f_len - f_t, r_len - r_t) >= T.MIN_AT_TRACT:
        if f_len - f_t >= r_len - r_t:
            centre = f_end - (f_len - 1) / 2.0
        else:
            centre = (len(window) - 1 - r_end) - (r_len - 1) / 2.0
    return (f_len, f_end, f_t), (r_len, r_end, r_t), centre


_short_call = lru_cache(1 << 16)(_window_call)  # short windows recur


def at_windows(text: str, lo: int = 0, hi: int | None = None):
    """(start, end, forward profile, reverse profile, centre or None) of each A/T window."""
    for m in _AT_WINDOW.finditer(text, lo, len(text) if hi is None else hi):
        start, end = m.span()
        forward, reverse, centre = (_short_call if end - start <= 32 else _window_call)(m.group())
        yield start, end, forward, reverse, None if centre is None else start + centre


_short_centre = lru_cache(1 << 16)(lambda window: _window_call(window)[2])


def at_centres(text: str) -> np.ndarray:
    """The centres of ``at_windows``, where there is one."""
    centres = []
    for m in _AT_WINDOW.finditer(text):
        window = m.group()
        offset = _short_centre(window) if len(window) <= 32 else _window_call(window)[2]
        if offset is not None:
            centres.append(m.start() + offset)
    return np.array(centres)


def phased_runs(centres: np.ndarray) -> list[np.ndarray]:
    """Maximal runs of sorted centres whose neighbours are one helical turn apart."""
    if len(centres) < T.MIN_PHASED_TRACTS:
        return []
    centres = np.sort(centres)
    step = np.diff(centres)
    starts, ends = true_runs((step >= T.PHASE_LOW) & (step <= T.PHASE_HIGH))
    return [centres[s : e + 1] for s, e in zip(starts, ends) if e - s + 1 >= T.MIN_PHASED_TRACTS]


def phased_span(run: np.ndarray, n: int) -> tuple[int, int]:
    """The reported span of a phased run in a text of ``n`` bases."""
    return max(0, int(run[0]) - 10), min(n, int(run[-1]) + 10)


# --- tandem and direct repeats -----------------------------------------------------------------
def tandem_repeats(raw: np.ndarray, unit: int, min_total: int = T.STR_MIN_TOTAL) -> list[tuple[int, int]]:
    """(start, copies) of greedy left-to-right tandem blocks with one unit length."""
    starts, ends = true_runs(raw[:-unit] == raw[unit:])
    need = max(unit, -(-min_total // unit) * unit - unit)
    out, busy = [], 0
    keep = ends - starts >= need
    for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
        s = max(s, busy)
        copies = (e - s) // unit + 1
        if e - s >= unit and copies * unit >= min_total:
            out.append((s, copies))
            busy = s + copies * unit
    return out


def tandem_spans(raw: np.ndarray, units, more: int) -> list[tuple[int, int]]:
    """Spans of a unit and at least ``more`` further copies: leftmost, longest unit of ``units`` first, as many copies as follow."""
    unit, stop = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for u in units:
        if len(raw) <= u:
            break
        starts, ends = true_runs(raw[:-u] == raw[u:])
        long = ends - starts >= u * more
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            unit[s : e - u * more + 1], stop[s : e - u * more + 1] = u, e
    out, pos = [], 0
    at = np.flatnonzero(unit)
    for i, u, e in zip(*(x.tolist() for x in (at, unit[at], stop[at]))):
        if i >= pos:
            pos = i + ((e - i) // u + 1) * u
            out.append((i, pos))
    return out


def tandem_score(unit: str, copies: int) -> float:
    """Instability of a perfect tandem block, scaled to 0..1.

    The score is the largest copies * sqrt(period) over repeats of at least three copies and ten
    bases inside the block. By periodicity only multiples of the smallest period repeat so often,
    and the smallest period wins; a block whose unit holds N has no such repeat.
    """
    n = len(unit)
    period = next(p for p in range(1, n + 1) if n % p == 0 and unit == unit[:p] * (n // p))
    copies *= n // period
    if copies < 3 or copies * period < 10 or "N" in unit:
        return 0.0
    best = copies * period**0.5
    return 1.0 if best > 8 else best / 10


def _run_to_mismatch(equal: np.ndarray, at: np.ndarray) -> np.ndarray:
    miss = np.flatnonzero(~equal)
    nxt = np.searchsorted(miss, at)
    stop = np.concatenate((miss, [len(equal)]))[nxt]
    return stop - at


WORD = 8
_PLACES = np.array([256**n for n in range(WORD)], np.uint64)


def byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zero bytes follow the end."""
    padded = np.concatenate((data, np.zeros(WORD, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WORD)[: len(data) + 1]).view("<u8").ravel()


def _walk(words: np.ndarray, left: np.ndarray, delta: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the text of ``byte_words`` at ``left`` equals the text ``delta`` further on, up to ``most``."""
    length = np.minimum(most, len(words) - 1 - left - delta)
    at = np.flatnonzero(length > 0)
    step = 0
    while len(at):
        here = left[at] + step
        differ = words[here] ^ words[here + delta[at]]
        ends = differ != 0
        last, differ = at[ends], differ[ends]
        same = np.searchsorted(_PLACES, differ & (~differ + np.uint64(1)), "right") - 1
        length[last] = np.minimum(length[last], step + same)
        step += WORD
        at = at[~ends]
        at = at[length[at] > step]
    return length


def _sorted_rows(*columns) -> list[np.ndarray]:
    """Columns of numbers that are not negative, sorted by the first, then the next; one sort of one packed column."""
    sizes = [int(x.max(initial=0)) + 1 for x in columns]
    if prod(sizes) >= 2**62:
        order = np.lexsort(columns[::-1])
        return [x[order] for x in columns]
    packed = columns[0].astype(np.int64)
    for x, size in zip(columns[1:], sizes[1:]):
        packed = packed * size + x
    packed.sort()
    out = []
    for size in sizes[:0:-1]:
        packed, x = np.divmod(packed, size)
        out.append(x)
    return [packed, *out[::-1]]


def _range_per_key(first, second, value):
    """The distinct keys (first, second) in their order, with the least and the largest value of each."""
    first, second, value = _sorted_rows(first, second, value)
    change = np.ones(len(value) + 1, bool)
    change[1:-1] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    heads, ends = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
    return first[heads], second[heads], value[heads], value[ends]


def _repeated_words(code: np.ndarray, k: int, n_core: int, max_delta: int):
    """(left, distance) of equal words at most ``max_delta`` apart and not overlapping."""
    at = np.flatnonzero(code >= 0)
    word, at = np.divmod(np.sort(code[at] * np.int64(len(code) + 1) + at), len(code) + 1)
    live = np.arange(len(at))  # whoever is not near at one lag is not at a larger one
    lag = 0
    while True:
        lag += 1
        live = live[: np.searchsorted(live, len(at) - lag)]
        delta = at[live + lag] - at[live]
        near = (word[live + lag] == word[live]) & (delta <= max_delta)
        live, delta = live[near], delta[near]
        if not len(live):
            return
        far = (delta >= k) & (at[live] < n_core)
        yield at[live[far]], delta[far]


def direct_repeats(raw: np.ndarray, n_core: int):
    """(left, unit, spacer) of direct repeats whose left unit starts in the core.

    Equal words are paired by sorting; a pair survives if the last word a unit of the least
    admissible length would need is equal too. Survivors are extended distance by distance.
    """
    k, max_unit, max_spacer = T.DIRECT_SEED, T.DIRECT_MAX_UNIT, T.DIRECT_MAX_SPACER
    none = np.empty((0, 3), np.int64)
    pairs, words = [], byte_words(raw)  # two words of eight bases cover a seed
    for left, delta in _repeated_words(word_codes(raw, k), k, n_core, max_unit + max_spacer):
        tail = left + np.maximum(k, delta - max_spacer) - k
        ok = tail + delta + k <= len(raw)
        left, delta, tail = left[ok], delta[ok], tail[ok]
        same = words[tail] == words[tail + delta]
        left, delta, tail = left[same], delta[same], tail[same] + k - WORD
        same = words[tail] == words[tail + delta]
        pairs.append((left[same], delta[same]))
    if not pairs:
        return none
    left, delta = (np.concatenate(x) for x in zip(*pairs))
    if not len(left):
        return none
    by_delta = np.argsort(delta.astype(np.int16), kind="stable")  # sorted by digits
    left, delta = left[by_delta], delta[by_delta]
    heads = np.concatenate(([0], np.flatnonzero(np.diff(delta)) + 1, [len(delta)]))
    unit = np.empty(len(left), np.int64)
    few = np.diff(heads) < len(raw) // 64  # a comparison of the whole text costs more than following these
    for s, e in zip(heads[:-1][~few], heads[1:][~few]):
        d = int(delta[s])
        unit[s:e] = np.minimum(_run_to_mismatch(raw[:-d] == raw[d:], left[s:e]), min(d, max_unit))
    walked = np.flatnonzero(np.repeat(few, np.diff(heads)))
    unit[walked] = _walk(words, left[walked], delta[walked], np.minimum(delta[walked], max_unit))
    good = unit >= np.maximum(k, delta - max_spacer)
    left, unit, delta = left[good], unit[good], delta[good]
    if not len(left):
        return none
    left, spacer, least, unit = _range_per_key(left, delta - unit, unit)
    order = np.argsort(left * 512 + spacer + least, kind="stable")  # as their first words are met
    return np.stack((left, unit, spacer), 1)[order]


_PROBE = 24


def _probe_codes(raw: np.ndarray) -> np.ndarray:
    """Base-4 code of the _PROBE bases at each position."""
    base = _BASE[raw].astype(np.int64)
    n = max(0, len(raw) - _PROBE + 1)
    code = np.zeros(n, np.int64)
    for t in range(_PROBE):
        code = code << 2 | base[t : t + n]
    return code


def _agreement(left: np.ndarray, right: np.ndarray) -> int:
    """How many elements agree before the first difference, looking at ever larger blocks."""
    at, block, n = 0, 64, min(len(left), len(right))
    while at < n:
        miss = np.flatnonzero(left[at : at + block] != right[at : at + block][: n - at])
        if len(miss):
            return at + int(miss[0])
        at, block = at + block, 2 * block
    return n


def _long_runs(raw: np.ndarray, code: np.ndarray, d: int, need: int):
    """Runs of at least ``need`` where the text equals itself ``d`` further on.

    Such a run holds a whole probe on a grid of half its length, so a distance costs 2 n / need
    comparisons, and all distances together n log n.
    """
    n = len(raw)
    probe = np.arange(0, n - d - _PROBE + 1, need // 2)
    last = 0
    for p in probe[code[probe] == code[probe + d]].tolist():
        if p < last:
            continue
        hi = p + _agreement(raw[p : n - d], raw[p + d :])
        lo = p - _agreement(raw[last:p][::-1], raw[last + d : p + d][::-1])
        last = hi
        if hi - lo >= need:
            yield lo, hi


def _recurring(raw: np.ndarray, k: int, near: int) -> np.ndarray:
    """Marks the positions whose word of ``k`` bases recurs at most ``near`` further on."""
    code = word_codes(raw, k)
    order = np.argsort(code, kind="stable")
    word, met = code[order], np.zeros(len(raw), bool)
    met[order[:-1][(word[1:] == word[:-1]) & (np.diff(order) <= near)]] = True
    return met


def _best_near(text: bytes, i: int, least: int, most: int, gap: int, near: int) -> tuple[int, int]:
    """Longest unit at ``i`` that recurs within ``near`` and its widest distance; zeros if there is none.

    Where a unit does not recur within its gap, the next place of its word tells which longer ones can."""
    unit, best, distance = least, 0, 0
    while unit <= most:
        word = text[i : i + unit]
        at = text.rfind(word, i + unit, i + min(unit + gap, near) + unit)
        if at >= 0:
            best, distance = unit, at - i
            unit += 1
            continue
        if unit + gap >= near:
            break
        at = text.find(word, i + unit + gap + 1, i + near + unit)
        if at < 0:
            break
        unit = max(unit + 1, at - i - gap)
    return best, distance


def _far_distances(code: np.ndarray, near: int, furthest: int):
    """Distances beyond ``near`` at which some probe recurs, ascending; all if probes recur too often."""
    order = np.argsort(code, kind="stable")
    word, live, lag, held = code[order], np.arange(len(code)), 0, 0
    met = np.zeros(furthest + 1, bool)
    while True:
        lag += 1
        live = live[: np.searchsorted(live, len(code) - lag)]
        live = live[word[live + lag] == word[live]]
        delta = order[live + lag] - order[live]
        live, delta = live[delta <= furthest], delta[delta <= furthest]
        held += len(live)
        if not len(live):
            return (np.flatnonzero(met[near + 1 :]) + near + 1).tolist()
        if held > 64 * len(code):
            return range(near + 1, furthest + 1)
        met[delta] = True


def spaced_repeats(raw: np.ndarray, least: int, most: int | None, gap: int) -> list[tuple[int, int]]:
    """Spans of unit, up to ``gap`` bases, same unit: leftmost, longest unit, widest gap first.

    The same spans as the back-reference ``(unit{least,most})(?:any{0,gap})\\1``. Near units are looked up
    where a hit may begin; far ones are found by comparing the text with itself at the distances where words recur.
    """
    n = len(raw)
    if n < 2 * least:
        return []
    most = n if most is None else most
    furthest = min(most + gap, n - least)
    near = min(furthest, gap + 2 * _PROBE + 16)  # up to here short runs count
    unit, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    code = _probe_codes(raw) if furthest > near else None
    for d in _far_distances(code, near, furthest) if furthest > near else ():
        need = max(least, d - gap)
        if need > n - d:
            break
        for lo, hi in _long_runs(raw, code, d, need):
            at = np.arange(lo, hi - need + 1)
            here = np.minimum(hi - at, min(d, most))
            better = here >= unit[at]
            unit[at[better]], distance[at[better]] = here[better], d
    out, pos, text = [], 0, raw.tobytes()
    starts = np.flatnonzero(_recurring(raw, min(least, 12), near) | (unit > 0))
    for i, far, apart in zip(*(x.tolist() for x in (starts, unit[starts], distance[starts]))):
        if i < pos:
            continue
        here, d = _best_near(text, i, least, most, gap, near)
        if far >= here:
            here, d = far, apart
        if here:
            pos = i + here + d
            out.append((i, pos))
    return out


def nearly_pure(raw: np.ndarray, letters: bytes, share: float, width: int) -> np.ndarray:
    """Positions inside some stretch of at least ``width`` bases with that share of ``letters``.

    With weights in the proportion of 1 - share for a wanted base to -share for another, such a stretch
    is one whose running sum does not drop; the furthest end per start is a search in the suffix maximum.
    """
    exact = Fraction(share).limit_denominator(1000)
    step = np.where(one_of(raw, letters), exact.denominator - exact.numerator, -exact.numerator)
    step[raw > 127] = -1000 * len(raw)  # gaps between sequences: no stretch crosses them
    height = np.concatenate(([0], np.cumsum(step)))
    ahead = np.maximum.accumulate(height[::-1])
    furthest = len(raw) - np.searchsorted(ahead, height[:-1])
    at = np.arange(len(raw))
    good = furthest - at >= width
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, at[good], 1)
    np.add.at(edge, furthest[good], -1)
    return np.cumsum(edge)[:-1] > 0


def periodic_runs(raw: np.ndarray, slack: int, periods):
    """Per position: period, start and end of the long periodic run it lies in (period 0: none)."""
    period, start, end = (np.zeros(len(raw), np.int64) for _ in range(3))
    for p in periods:
        if len(raw) < 4 * p + slack:
            break
        same, half = raw[:-p] == raw[p:], (3 * p + slack + 1) // 2
        if not same[: len(same) // half * half].reshape(-1, half).all(axis=1).any():  # a long run covers such a block
            continue
        s, e = true_runs(same)
        long = e - s + p >= 4 * p + slack
        for lo, hi in zip(s[long], e[long] + p):
            free = np.flatnonzero(period[lo:hi] == 0) + lo
            period[free], start[free], end[free] = p, lo, hi
    return period, start, end


_PAIR_BLOCK, _PAIRS_AT_ONCE, _HELD_ARMS = 1 << 17, 1 << 18, 1 << 20


def _paired_words(own: np.ndarray, pair: np.ndarray, usable: np.ndarray, k: int, max_loop: int):
    """(left, right) of paired words, in pieces; the right words of one piece are not in another.

    Places are sorted by word, so the left words of a right one are a stretch that two searches bound.
    """
    at, right = np.flatnonzero(usable), np.flatnonzero(pair >= 0)
    if 4**k <= 1 << 20:  # most words have no partner where few positions are usable
        held = np.zeros(4**k, bool)
        held[own[at]] = True
        right = right[held[pair[right]]]
    width = len(own) + k + max_loop + 1  # a search that begins before the text stays within its word
    key = np.sort(own[at].astype(np.int64) * width + at + k + max_loop)
    wanted = np.sort(pair[right].astype(np.int64) * width + right)
    for lo in range(0, len(wanted), _PAIR_BLOCK):
        block = wanted[lo : lo + _PAIR_BLOCK]
        first = np.searchsorted(key, block)
        count = np.searchsorted(key, block + max_loop, "right") - first
        some = np.flatnonzero(count)
        first, count, right = first[some], count[some], block[some] % width
        piece = np.cumsum(count) // _PAIRS_AT_ONCE
        heads = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
        for s, e in zip(heads, [*heads[1:], len(piece)]):
            n = count[s:e]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield key[np.repeat(first[s:e], n) + nth] % width - k - max_loop, np.repeat(right[s:e], n)


def paired_arms(raw: np.ndarray, k: int, max_loop: int, n_core: int, complement: bool, inside=None):
    """(left, right, arm, first right of its key) of inverted (or mirror) repeats.

    Seeds are k-mers whose partner word starts k..k+max_loop further on. A longer arm must keep
    the seed relation at both ends, so it is found by walking outwards from an inner seed and
    testing that the outer left word equals the inner one.

    Inside a long run with a period of at most k, a paired seed means the whole run pairs, so
    the same hit recurs one period further in, with a longer arm, up
    to the end of the run. Only the hits near that end can win their key, so walkers jump there
    and the others are not listed; this keeps microsatellites linear. ``inside`` marks the
    positions a left arm may cover, if the caller only wants some.

    Seeds are followed a piece of the right words at a time, and of the arms of one left and right the
    longest is kept as they come, so memory follows the hits and not the seeds.
    """
    none = np.empty((0, 4), np.int64)
    own = word_codes(raw, k)
    pair = word_codes(raw, k, "revcomp" if complement else "reverse")
    partner = _COMPLEMENT[raw] if complement else raw
    usable = own >= 0
    if inside is not None:
        usable &= inside[: len(own)] & inside[k - 1 :]
    runs = None
    pieces = []
    for inner, right in _paired_words(own, pair, usable, k, max_loop):
        if runs is None:
            runs = periodic_runs(raw, 2 * max_loop + 4 * k, range(1, k + 1))
        pieces.append(_longest_arms(raw, partner, own, k, max_loop, n_core, inner, right, *(x[inner] for x in runs)))
    if not pieces:
        return none
    left, right, arm = (np.concatenate(x) for x in zip(*pieces))
    if not len(left):
        return none
    left, loop, least, arm = _range_per_key(left, right - left - arm, arm)
    return np.stack((left, left + arm + loop, arm, left + least + loop), 1)


def _longest_arms(raw, partner, own, k, max_loop, n_core, inner, right, period, run_start, run_end):
    """(left, right, arm): the longest arm per left and right that paired words lead to."""
    horizon = run_end - 2 * period - max_loop - 1
    walk = np.zeros(len(inner), np.int64)
    out = right + k - 1
    found, held = [], 0

    def longest():
        left, right, arm = (np.concatenate(x) for x in zip(*found))
        left, apart, _, arm = _range_per_key(left, right - left, arm)
        return left, left + apart, arm

    while len(inner):
        left = inner - walk
        listed = own[left] == own[inner]
        listed &= ~((period > 0) & (left >= run_start) & (out < horizon)) & (left < n_core)
        found.append((left[listed], right[listed], k + walk[listed]))
        held += len(found[-1][0])
        if held >= _HELD_ARMS:
            found = [longest()]
            held = 0
        inside = (period > 0) & (left > run_start) & (out < horizon)
        walk = walk + np.where(inside, np.maximum(np.minimum(horizon - out, left - run_start), 1), 1)
        out = right + k - 1 + walk
        ok = (walk <= inner) & (out < len(raw))
        ok[ok] = raw[inner[ok] - walk[ok]] == partner[out[ok]]
        inner, right, walk, out = inner[ok], right[ok], walk[ok], out[ok]
        period, run_start, horizon = period[ok], run_start[ok], horizon[ok]
    return longest()


# --- scored 10-mers --------------------------------------------------------------------------
def _by_code(scores: dict[str, float]) -> np.ndarray:
    """Scores by packed 10-mer code; NaN where a 10-mer is not listed."""
    table = np.full(4**10, np.nan)
    for word, score in scores.items():
        table[int(word.translate(str.maketrans("ACGT", "0123")), 4)] = score
    return table


_Z_SCORES, _A_SCORES = _by_code(tenmers.Z_DNA), _by_code(tenmers.A_PHILIC)
_Z_LISTED, _A_LISTED = (np.append(~np.isnan(scores), False) for scores in (_Z_SCORES, _A_SCORES))  # the last one is code -1


def _listed(raw: np.ndarray, scores: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where listed 10-mers begin, and their scores."""
    code = word_codes(raw, 10)
    at = np.flatnonzero(listed[code])
    return at, scores[code[at]]


def z_tenmers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _listed(raw, _Z_SCORES, _Z_LISTED)


def a_philic_tenmers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _listed(raw, _A_SCORES, _A_LISTED)


def merged_tenmers(at: np.ndarray, score: np.ndarray):
    """(start, end, n, sum) of merged overlapping or adjacent 10-mers."""
    if not len(at):
        return []
    head = np.concatenate(([0], np.flatnonzero(np.diff(at) > 10) + 1))
    tail = np.concatenate((head[1:], [len(at)]))
    total = np.add.reduceat(score, head)
    return [
        (int(at[h]), int(at[t - 1]) + 10, int(t - h), float(x)) for h, t, x in zip(head, tail, total)
    ]


# --- R-loop extension zone ------------------------------------------------------------------
def percent(count, total):
    """``count`` in percent of ``total`` to two digits as ``round_even(count * 100.0 / total, 2)`` in SQL: 427 of 800 are 53.38.

    The order of the operations counts: 427 / 800 * 100 falls short of 53.375."""
    return np.round(count * 100.0 / total, 2)


def extension_zone(g_before: np.ndarray, riz_end: int, n: int):
    """Best (start, end, G%) downstream of an initiation zone, or None.

    ``g_before`` is the running count of G, so every grid cell costs one subtraction.
    """
    starts = np.arange(riz_end + T.REZ_LINKER, min(n, riz_end + T.REZ_MAX), T.REZ_STEP)
    lengths = np.arange(T.REZ_END_STEP, T.REZ_MAX, T.REZ_END_STEP)
    if not len(starts):
        return None
    ends = starts[:, None] + lengths[None, :]
    inside = ends < np.minimum(n, starts + T.REZ_MAX)[:, None]
    count = g_before[np.minimum(ends, n)] - g_before[starts][:, None]
    share = percent(count, lengths)
    score = np.where(inside & (share >= T.REZ_MIN_G), share * lengths / 100.0, 0.0)
    best = int(score.argmax())
    row, col = divmod(best, len(lengths))
    if score[row, col] <= 0:
        return None
    return int(starts[row]), int(ends[row, col]), float(share[row, col])
