"""Scalar sequence expressions. Everything here is a Column in, Column out, inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IUPAC_FROM, IUPAC_TO = "ATGCRYSWKMBVDHN-", "TACGYRSWMKVBHDN-"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(seq, letters: str) -> Column:
    """How many of ``letters`` occur."""
    seq = _col(seq)
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def normalise(bases) -> Column:
    """RNA to DNA, upper case."""
    return F.translate(F.upper(_col(bases)), "U", "T")


def reverse_complement(bases) -> Column:
    """IUPAC reverse complement, upper-cased."""
    return F.reverse(F.translate(F.upper(_col(bases)), IUPAC_FROM, IUPAC_TO))


def revcomp(bases) -> Column:
    """ACGT-only reverse complement that keeps case."""
    return F.reverse(F.translate(_col(bases), "ACGTacgt", "TGCAtgca"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def gc_content(bases) -> Column:
    upper = F.upper(_col(bases))
    return percent(count_of(upper, "GC"), F.length(upper))


def at_content(bases) -> Column:
    return 100.0 - gc_content(bases)


def gc_percent(part, digits: int = 2) -> Column:
    """GC of a motif component, rounded; 0 for an empty component."""
    part = _col(part)
    return F.round(percent(count_of(part, "GC"), F.length(part)), digits)


def melting_temperature(bases) -> Column:
    upper, n = F.upper(_col(bases)), F.length(_col(bases))
    return (
        F.when(n < 2, F.lit(0.0))
        .when(n <= 13, (count_of(upper, "AT") * 2 + count_of(upper, "GC") * 4).cast("double"))
        .otherwise(64.9 + 41 * (gc_content(bases) / 100) - 650 / n)
    )


def is_palindrome(bases) -> Column:
    return F.upper(_col(bases)) == reverse_complement(bases)


def validation_message(bases) -> Column:
    bases = _col(bases)
    return (
        F.when(bases.isNull() | (bases == ""), F.lit("Empty sequence"))
        .when(~F.upper(bases).rlike("^[ATGCRYSWKMBDHVN-]*$"), F.lit("Invalid characters found"))
        .when(F.length(bases) < 10, F.lit("Sequence too short (minimum 10 bp)"))
        .otherwise(F.lit("Valid sequence"))
    )


def is_valid(bases) -> Column:
    return validation_message(bases) == "Valid sequence"


def wrap(text, width: int = 80) -> Column:
    return F.regexp_replace(_col(text), f"(.{{{width}}})(?=.)", "$1\n") if width > 0 else _col(text)


def shortened(text, limit: int = 50) -> Column:
    text = _col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def significance(p) -> Column:
    p = _col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def capped_fold(fold, cap: float = 100.0) -> Column:
    """Infinite fold enrichment drawn as a finite bar."""
    fold = _col(fold)
    return F.when(fold == float("inf"), F.lit(cap)).otherwise(fold)
