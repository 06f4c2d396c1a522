"""Whole-sequence scores, contributing words, and choices across classes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill import tables as T

from helixmill.operators import kernels as K
from helixmill.operators.motifs import scored, select_winners
from helixmill.operators.overlap import select_non_overlapping
from helixmill.operators.repeats import _per_chunk_arrays


def validated_i_motifs(sequences: DataFrame, reverse: bool = False) -> DataFrame:
    """The first place of each known i-motif per sequence, 1-based; with ``reverse`` also of its other strand."""
    rows = []
    for vid, known, description, citation in T.VALIDATED_I_MOTIFS:
        forward = F.instr("bases", known)
        back = F.locate(revcomp_text(known), F.col("bases")) if reverse else F.lit(0)
        at = F.when(forward > 0, forward).otherwise(back)
        rows.append(
            F.struct(
                F.lit(vid).alias("id"), at.cast("long").alias("start"), (at + len(known) - 1).cast("long").alias("end"),
                F.when(forward > 0, "+").otherwise("-").alias("strand"),
                F.lit(description).alias("description"), F.lit(citation).alias("citation"),
            )
        )
    return sequences.select("seq_id", F.inline(F.array(*rows))).where("start > 0")


def revcomp_text(word: str) -> str:
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def detector_scores(sequences: DataFrame, detector: int) -> DataFrame:
    """seq_id, class and the detector's score of the whole sequence; sequences without hits have no row.

    Curved DNA and the scored 10-mers add up every hit, G-quadruplex and i-motif what remains after
    overlaps, the latter by length and 0.99 for a known i-motif; R-loop is capped at 1. Inverted
    repeats have no such sum here, since hits inside periodic runs are not listed one by one.
    """
    rows = scored(sequences, (detector,))
    span, value = (F.col("end") - F.col("start")) / 10.0, F.col("raw_score")
    if detector in (T.R_LOOP, T.G4, T.I_MOTIF):
        rows = select_winners(rows, (detector,))
    if detector == T.I_MOTIF:
        value = value * F.greatest(F.lit(1.0), span)
    total = F.sum(value)
    if detector == T.R_LOOP:
        total = F.least(total, F.lit(1.0))
    found = rows.groupBy("seq_id").agg(total.alias("score"))
    if detector == T.I_MOTIF:
        known = validated_i_motifs(sequences).select("seq_id").distinct().withColumn("_known", F.lit(0.99))
        found = found.join(known, "seq_id", "full").select("seq_id", F.coalesce("_known", "score").alias("score"))
    return found.select("seq_id", F.lit(T.CLASS_NAMES[detector]).alias("class"), "score")


def contributing_tenmers(sequences: DataFrame, detector: int) -> DataFrame:
    """Every scored 10-mer with the start of the merged region it belongs to, 1-based.

    Cuts lie outside of merged regions, so each region is known in its chunk."""
    finder = {T.Z_DNA: K.z_tenmers, T.A_PHILIC: K.a_philic_tenmers}[detector]

    def columns(raw, n, lo):
        at, score = finder(raw[:n])
        opens = np.diff(at, prepend=at[:1] - 11) > 10
        region = at[opens][np.cumsum(opens) - 1]
        return region + lo + 1, at + lo + 1, raw[at[:, None] + np.arange(10)], score

    return _per_chunk_arrays(sequences, "seq_id bigint, region_start bigint, start bigint, tenmer string, score double", columns)


def composite_summary(motifs: DataFrame) -> DataFrame:
    """One row: number of hybrids, of clusters, and their mean length as a whole number."""
    both = motifs.where(F.col("class").isin(T.HYBRID, T.CLUSTER))
    return both.agg(
        F.count_if(F.col("class") == T.HYBRID).alias("n_hybrid"),
        F.count_if(F.col("class") == T.CLUSTER).alias("n_cluster"),
        F.coalesce(F.floor(F.avg("length")), F.lit(0)).alias("avg_length"),
    )


def resolve_across_classes(motifs: DataFrame, mode: str = "strict", order: list[Column] | None = None) -> DataFrame:
    """``strict`` keeps the best of motifs that overlap whatever their class; ``hybrid`` keeps all.

    Best score first, then the longer; further ties by ``order``. Two motifs may share one base.
    """
    if mode == "hybrid":
        return motifs
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    best = [-F.coalesce("score", F.lit(0.0)), F.col("start") - F.col("end"), *(order or [F.col("start")])]
    return select_non_overlapping(motifs, [], best, slack=1, binned=False)


def merge_detector_results(results: dict[str, DataFrame], mode: str = "strict") -> DataFrame:
    """Motif tables by detector name, tagged with it, united and resolved across classes."""
    tagged = [
        df if "detector" in df.columns else df.withColumn("detector", F.lit(name)) for name, df in results.items()
    ]
    return resolve_across_classes(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), mode)


def in_order(motifs: DataFrame) -> DataFrame:
    """The order of a final report: by sequence and start."""
    return motifs.orderBy("seq_id", "start", "end", "class", "subclass")
