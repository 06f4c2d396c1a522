"""Motif scoring expressions over a sequence column.

All scores are Columns. Runs of bases are taken with ``regexp_extract_all`` and folded with
higher-order functions, so scoring stays in the JVM. Only three searches that have no such form
(tandem instability, longest palindrome, direct repeats) are array functions in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from helixmill import tables as T
from helixmill.functions.sequence import _col, count_of, percent
from helixmill.operators.kernels import complement, to_bytes, true_runs


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decimals(x, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the scaled double is taken to the nearest integer, while
    ``F.round`` looks at its printed digits (1.5594999999999999 gives 1.56 here and 1.559 there)."""
    scale = F.lit(10.0**digits)
    return F.round(_col(x) * scale) / scale


def tracts(seq, regex: str) -> Column:
    return F.regexp_extract_all(_col(seq), F.lit(f"({regex})"), F.lit(1))


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))


def power_sum(parts: Column, exponent: float) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.pow(F.length(x).cast("double"), F.lit(exponent)))


def skew_peak(seq, window: Column) -> Column:
    """max |#G - #C| over all windows of the given width; 0 for an empty sequence."""
    seq = _col(seq)
    last = F.length(seq) - window
    peaks = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.abs(
            F.length(F.translate(seq.substr(i + 1, window), "C", ""))
            - F.length(F.translate(seq.substr(i + 1, window), "G", ""))
        ),
    )
    return F.coalesce(F.array_max(peaks), F.lit(0))


def g4hunter(seq, window: int = T.G4_WINDOW) -> Column:
    width = F.least(F.lit(window), F.length(_col(seq)))
    return F.when(width > 0, skew_peak(seq, width) / width).otherwise(F.lit(0.0))


def g4_region(seq) -> Column:
    """Window peak plus tract bonus minus C penalty, clamped, scaled by length over window."""
    seq = _col(seq)
    n = F.length(seq)
    width = F.least(F.lit(T.G4_WINDOW), n)
    runs = tracts(seq, "G{2,}")
    n_runs = F.size(runs)
    bonus = F.when(
        n_runs >= 3,
        F.least(F.lit(0.5), F.lit(0.08) * (n_runs - 2) * ((total_length(runs) / n_runs) / F.lit(4.0))),
    ).otherwise(F.lit(0.0))
    balance = (count_of(seq, "G") - count_of(seq, "C")) / n
    penalty = F.when(balance < -0.3, 0.2).when(balance < -0.1, 0.1).otherwise(0.0)
    return clamp(g4hunter(seq) + bonus - penalty) * (n / width)


def canonical_imotif(seq) -> Column:
    seq = _col(seq)
    runs = tracts(seq, "C{2,}")
    return F.when((F.length(seq) < 12) | (F.size(runs) < 3), F.lit(0.0)).otherwise(
        clamp(total_length(runs) / F.length(seq) + F.least(F.lit(0.4), F.lit(0.12) * (F.size(runs) - 2)))
    )


def hur_imotif(seq, linker) -> Column:
    seq, linker = _col(seq), _col(linker)
    tract = F.when((F.size(tracts(seq, "A{3,}")) >= 1) & (F.size(tracts(seq, "C{3,}")) >= 3), 0.5).otherwise(0.0)
    base = F.least(F.lit(0.6), count_of(seq, "AC") / F.length(seq) * 0.8)
    boost = F.when(linker.isin(4, 5), 0.25).when(linker == 6, 0.12).otherwise(0.0)
    return clamp(base + tract + boost)


def triplex_tract(seq) -> Column:
    """Arms longer than 20 that are over 90 % purine or pyrimidine, scaled by length."""
    seq = _col(seq)
    return triplex_share(count_of(seq, "AG"), count_of(seq, "CT"), F.length(seq))


def triplex_share(purines: Column, pyrimidines: Column, n: Column) -> Column:
    """The score of a tract by its counted letters."""
    purine, pyrimidine = purines / n, pyrimidines / n
    share = F.when(purine > 0.9, purine).otherwise(0.0) + F.when(pyrimidine > 0.9, pyrimidine).otherwise(0.0)
    return F.when(n < 20, F.lit(0.0)).otherwise(F.least(share * n / 150, F.lit(1.0)))


def sticky(seq) -> Column:
    seq = _col(seq)
    n = F.length(seq)
    units = F.regexp_count(seq, F.lit("GAA")) + F.regexp_count(seq, F.lit("TTC"))
    runs = total_length(tracts(seq, "(?:GAA){2,}")) + total_length(tracts(seq, "(?:TTC){2,}"))
    return F.when(n < 12, F.lit(0.0)).otherwise(
        F.least(F.lit(0.7) * ((units * 3) / n) + F.lit(0.3) * (runs / n), F.lit(1.0))
    )


def inverted_arms(arm, loop, match_fraction=1.0) -> Column:
    arm, loop = _col(arm), _col(loop)
    reach = F.greatest(F.lit(0.0), F.lit(1.0) - loop / F.lit(float(T.INVERTED_MAX_LOOP)))
    fraction = match_fraction if isinstance(match_fraction, Column) else F.lit(float(match_fraction))
    return clamp(arm / (arm + F.lit(8.0)) * reach * fraction)


# --- the library scores ---------------------------------------------------------------------
def imotif_score(seq) -> Column:
    seq = _col(seq)
    runs = tracts(seq, "C{2,}")
    return F.when((F.length(seq) < 12) | (F.size(runs) < 3), F.lit(0.0)).otherwise(
        F.least(total_length(runs) / F.length(seq) + (F.size(runs) / 4) * 0.2, F.lit(1.0))
    )


def alternation_steps(seq) -> Column:
    """Neighbouring purine/pyrimidine pairs, overlapping ones included."""
    return F.regexp_count(_col(seq), F.lit("(?=[AG][CT]|[CT][AG])"))


def z_dna_score(seq) -> Column:
    seq = _col(seq)
    bonus = F.regexp_count(seq, F.lit("(?=CG|GC)")) * 0.5
    return F.when(F.length(seq) < 6, F.lit(0.0)).otherwise((alternation_steps(seq) + bonus) / (F.length(seq) - 1))


def curvature_score(seq) -> Column:
    seq = _col(seq)
    bend = power_sum(tracts(seq, "A{3,}"), 1.5) + power_sum(tracts(seq, "T{3,}"), 1.5)
    return F.when(F.length(seq) < 4, F.lit(0.0)).otherwise(F.least(bend / F.length(seq), F.lit(1.0)))


def triplex_potential(seq) -> Column:
    seq = _col(seq)
    best = F.greatest(power_sum(tracts(seq, "[AG]{5,}"), 1.2), power_sum(tracts(seq, "[CT]{5,}"), 1.2))
    return F.when(F.length(seq) < 15, F.lit(0.0)).otherwise(
        F.least(best / F.pow(F.length(seq).cast("double"), F.lit(1.2)), F.lit(1.0))
    )


def r_loop_potential(seq) -> Column:
    seq = _col(seq)
    n = F.length(seq)
    skew = F.abs(count_of(seq, "G") - count_of(seq, "C")) / n
    return F.when(n < 20, F.lit(0.0)).otherwise(F.least(skew * 0.6 + count_of(seq, "GC") / n * 0.4, F.lit(1.0)))


qmrlfs_score = r_loop_potential  # the dedicated scorer is optional and absent


def a_philic_score(seq) -> Column:
    seq = _col(seq)
    n = F.length(seq)
    bonus = power_sum(tracts(seq, "A{3,}"), 1.2) / n
    return F.when(n < 6, F.lit(0.0)).otherwise(F.least(count_of(seq, "A") / n * 0.7 + bonus * 0.3, F.lit(1.0)))


def _per_text(one):
    """A column function from ``one(bytes as numpy array) -> float``, by Arrow batches."""

    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: one(to_bytes(text)))

    return F.pandas_udf(scores, DoubleType())


def _instability(raw: np.ndarray) -> float:
    n, best = len(raw), 0.0
    for unit in range(1, min(7, n // 3)):
        starts, ends = true_runs(raw[:-unit] == raw[unit:])
        longest = int((ends - starts).max(initial=0))
        if longest >= 2 * unit:
            best = max(best, (longest // unit + 1) * unit**0.5)
    return min(best / 10, 1.0)


def _palindrome(raw: np.ndarray) -> float:
    n, best = len(raw), 0
    other = complement(raw)
    for odd in (0, 1):  # an odd length needs a middle letter that pairs with itself, such as N
        left = np.arange(n - 1 + odd)
        right = left + 1 - odd
        half = 0
        while len(left):
            alike = raw[left] == other[right]
            left, right = left[alike] - 1, right[alike] + 1
            half += bool(len(left))
            inside = (left >= 0) & (right < n)
            left, right = left[inside], right[inside]
        best = max(best, 2 * half - (odd if half else 0))
    return min(best**1.5 / n, 1.0) if n >= 8 and best >= 8 else 0.0


def _direct_repeat(raw: np.ndarray) -> float:
    n, best = len(raw), 0.0
    for delta in range(10, min(310, n - 10) + 1):
        starts, ends = true_runs(raw[:-delta] == raw[delta:])
        long = ends - starts >= max(10, delta - 10)
        for start, end in zip(starts[long], ends[long]):
            i = np.arange(start, end)
            unit = np.minimum(np.minimum(end - i, min(delta, 300)), (n - i - 10) // 2)
            unit = unit[(unit >= max(10, delta - 10)) & (delta + unit < n - i)]
            if len(unit):
                best = max(best, float(unit.max()) / (1 + delta - int(unit.max())))
    return min(best / 50, 1.0)


#: copies * sqrt(unit) of the strongest tandem unit of 1..6 bases, at least three copies
instability_score = _per_text(_instability)
#: length^1.5 / n of the longest perfect reverse palindrome of eight or more bases
cruciform_stability = _per_text(_palindrome)
#: best unit / (1 + spacer) over direct repeats of unit 10..300 and spacer 0..10, over 50
direct_repeat_score = _per_text(_direct_repeat)


# --- legacy scores --------------------------------------------------------------------------
def legacy_g4hunter(seq) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) < 10, F.lit(0.0)).otherwise((count_of(seq, "G") - count_of(seq, "C")) / F.length(seq))


def legacy_curvature(seq) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) < 4, F.lit(0.0)).otherwise(
        F.least(F.regexp_count(seq, F.lit("[AT]{3,}")) / (F.length(seq) / 10), F.lit(1.0))
    )


def legacy_z_dna(seq) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) < 6, F.lit(0.0)).otherwise(alternation_steps(seq) / (F.length(seq) - 1))


def legacy_triplex(seq) -> Column:
    seq = _col(seq)
    n = F.length(seq)
    return F.when(n < 10, F.lit(0.0)).otherwise(F.greatest(count_of(seq, "GA") / n, count_of(seq, "CT") / n))


def legacy_score(seq, motif_class) -> Column:
    seq, motif_class = _col(seq), _col(motif_class)
    return (
        F.when(motif_class == "g_quadruplex", F.abs(legacy_g4hunter(seq)))
        .when(motif_class == "curved_dna", legacy_curvature(seq))
        .when(motif_class == "z_dna", legacy_z_dna(seq))
        .when(motif_class == "triplex", legacy_triplex(seq))
        .otherwise(F.least(F.length(seq) / 50, F.lit(1.0)))
    )


SCORES = {
    "g4hunter_score": g4hunter,
    "imotif_score": imotif_score,
    "z_dna_score": z_dna_score,
    "curvature_score": curvature_score,
    "triplex_potential": triplex_potential,
    "r_loop_potential": r_loop_potential,
    "qmrlfs_score": qmrlfs_score,
    "instability_score": instability_score,
    "cruciform_stability": cruciform_stability,
    "a_philic_score": a_philic_score,
}
