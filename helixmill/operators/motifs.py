"""From scan candidates to motif rows: scores, gates, overlap order, reported fields.

Everything is a Column expression over the candidate row; the only Python between the scan and
the motif table is the in-chunk settling of overlaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill import catalogs, tables as T
from helixmill.functions import scoring as S
from helixmill.functions.sequence import count_of, gc_percent, percent
from helixmill.operators.overlap import ORDER_KEYS, resolve_open, settle_in_chunks
from helixmill.operators.scan import SCANNERS, scan_candidates
from helixmill.session import materialize

ALL = tuple(SCANNERS)
MOTIF_COLUMNS = [
    "seq_id",
    "id",
    "seq_name",
    "seq_len",
    "class",
    "subclass",
    "start",
    "end",
    "length",
    "sequence",
    "score",
    "strand",
    "method",
    "pattern_id",
    "det_order",
    "emit_order",
    "details",
]


def _per_detector(cases: dict[int, Column], default=None) -> Column:
    picked = reduce(lambda acc, kv: acc.when(F.col("det") == kv[0], kv[1]), cases.items(), F.when(F.lit(False), default))
    return picked.otherwise(default)


def _lookup(pairs) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return table[F.col("family")]


def raw_score(full: bool = True) -> Column:
    """The detector's own score, unrounded."""
    arm, loop = F.col("arm"), F.col("loop")
    zone = F.coalesce(F.col("rez_pct") * (F.col("rez_end") - F.col("rez_start")) / 100.0, F.lit(0.0))
    span = F.col("end") - F.col("start")
    return _per_detector(
        {
            T.CURVED: F.when(F.col("family") == "APR", F.col("raw")).otherwise(F.round(span / (span + 6.0), 6)),
            T.SLIPPED: F.when(F.col("family") == "STR", F.col("raw")).otherwise(F.least(F.col("unit") / 30.0, F.lit(0.95))),
            T.CRUCIFORM: F.round(S.inverted_arms(arm, loop), 6),
            T.R_LOOP: F.col("raw") / 100.0 + zone / 100.0,
            T.TRIPLEX: F.when(arm.isNotNull(), S.triplex_share(F.col("unit"), F.col("copies"), span)).otherwise(S.sticky("seq")),
            T.G4: S.g4_region("seq"),
            T.I_MOTIF: F.when(F.col("family") == "ac_motif_hur", S.hur_imotif("seq", "unit")).otherwise(S.canonical_imotif("seq")),
            T.Z_DNA: F.col("raw"),
            T.A_PHILIC: F.col("raw"),
        }
    )


def _floor() -> Column:
    """The score a candidate has to exceed."""
    return _per_detector(
        {
            T.CURVED: F.lit(T.CURVED_GATE),
            T.CRUCIFORM: F.lit(T.CRUCIFORM_GATE),
            T.Z_DNA: F.lit(T.Z_GATE),
            T.A_PHILIC: F.lit(T.A_PHILIC_GATE),
        },
        F.lit(-1.0),
    )


def _subclass() -> Column:
    return _per_detector(
        {
            T.CURVED: F.when(F.col("family") == "APR", "Global Curvature").otherwise("Local Curvature"),
            T.SLIPPED: F.when(F.col("family") == "STR", "STR").otherwise("Direct_Repeat"),
            T.CRUCIFORM: F.lit("Inverted_Repeat"),
            T.R_LOOP: _lookup([(f, sub) for f, _, _, sub, _, _ in catalogs.RIZ]),
            T.TRIPLEX: F.col("family"),
            T.G4: _lookup([(f, sub) for f, _, _, sub, _, _ in catalogs.G4_FAMILIES]),
            T.I_MOTIF: F.when(F.col("family") == "canonical_imotif", "Canonical i-Motif").otherwise("HUR AC-Motif"),
            T.Z_DNA: F.lit("Z-DNA"),
            T.A_PHILIC: F.lit("A-philic DNA"),
        }
    )


def _with_order(df: DataFrame) -> DataFrame:
    """grp, slack, reach and the ascending sort keys k1..k4 of each detector's selection."""
    score, rounded = F.col("raw_score"), F.round("raw_score", 3)
    span = (F.col("end") - F.col("start")).cast("double")
    g4_rank = _lookup([(f, float(n)) for n, f in enumerate(T.G4_PRIORITY)])
    imotif_rank = _lookup([("canonical_imotif", 1.0), ("hur_ac_motif", 2.0), ("ac_motif_hur", 999.0)])
    zone = F.coalesce(F.col("rez_pct") * (F.col("rez_end") - F.col("rez_start")) / 100.0, F.lit(0.0))
    by_detector = lambda cases: _per_detector(cases, F.lit(0.0))
    return df.select(
        "*",
        _per_detector(
            {
                T.CURVED: F.concat(F.lit("curved/"), F.col("family")),
                T.SLIPPED: F.concat(F.lit("slipped/"), F.col("family")),
                T.CRUCIFORM: F.lit("cruciform"),
                T.R_LOOP: F.lit("r_loop"),
                T.TRIPLEX: F.lit("triplex"),
                T.G4: F.lit("g4"),
                T.I_MOTIF: F.lit("i_motif"),
            }
        ).alias("grp"),
        F.when(F.col("det").isin(T.CURVED, T.SLIPPED), 1).otherwise(0).alias("slack"),
        _per_detector(
            {d: F.greatest(F.lit(r), "far") if d in (T.CRUCIFORM, T.TRIPLEX) else F.lit(r) for d, r in T.REACH.items()}, F.lit(0)
        ).cast("long").alias("reach"),
        by_detector(
            {
                T.CURVED: -rounded,
                T.SLIPPED: -rounded,
                T.CRUCIFORM: -score,
                T.R_LOOP: -F.col("raw") - zone,
                T.TRIPLEX: F.col("raw"),
                T.G4: -score,
                T.I_MOTIF: -score,
            }
        ).alias("k1"),
        by_detector(
            {
                T.CURVED: -span,
                T.SLIPPED: -span,
                T.CRUCIFORM: -span,
                T.R_LOOP: -span,
                T.TRIPLEX: F.col("seen").cast("double"),
                T.G4: g4_rank,
                T.I_MOTIF: imotif_rank,
            }
        ).alias("k2"),
        by_detector(
            {
                T.CRUCIFORM: F.col("start").cast("double"),
                T.R_LOOP: F.when(F.col("family") == "qmrlfs_model_1", 0.0).otherwise(1.0),
                T.TRIPLEX: F.col("start").cast("double"),
                T.G4: -span,
                T.I_MOTIF: -span,
            }
        ).alias("k3"),
        F.col("chunk_start").cast("double").alias("k4"),
        F.col("emit").cast("double").alias("k5"),
    )


def _pattern_id() -> Column:
    hur = F.lit("IMOT")
    return _per_detector(
        {
            T.CURVED: F.when(F.col("family") == "APR", "CRV_APR").otherwise("CRV_TRACT"),
            T.SLIPPED: F.when(F.col("family") == "STR", F.concat(F.lit("SLP_STR_"), F.col("unit"))).otherwise("SLP_DIR_1"),
            T.CRUCIFORM: F.lit("CRU"),
            T.R_LOOP: F.lit("QmRLFS"),
            T.TRIPLEX: F.when(F.col("family") == "Homopurine mirror repeat", "TRX_MR_PU")
            .when(F.col("family") == "Homopyrimidine mirror repeat", "TRX_MR_PY")
            .otherwise(_lookup([(name, pid) for name, _, pid, *_ in catalogs.STICKY])),
            T.G4: _lookup([(f, pid) for f, _, pid, *_ in catalogs.G4_FAMILIES]),
            T.I_MOTIF: hur,
            T.Z_DNA: F.lit("ZDNA"),
            T.A_PHILIC: F.lit("APHIL"),
        }
    )


def _id_tag() -> Column:
    """The middle part of the motif id."""
    return F.when(F.col("det") == T.R_LOOP, F.lit("RLOOP")).otherwise(_pattern_id())


def _details() -> Column:
    """Typed component fields; null where a class does not have them."""
    det, seq, n = F.col("det"), F.col("seq"), F.length("seq")
    arm, loop, unit = F.col("arm"), F.col("loop"), F.col("unit")

    def only(dets, value, cond=None):
        test = det.isin(*dets) if isinstance(dets, tuple) else det == dets
        return F.when(test if cond is None else test & cond, value)

    has_arms = (T.CRUCIFORM, T.TRIPLEX)
    armed = arm.isNotNull()
    left, right = seq.substr(F.lit(1), arm), seq.substr(n - arm + 1, arm)
    loop_seq = seq.substr(arm + 1, loop)
    is_str, is_direct = F.col("family") == "STR", F.col("family") == "DIRECT"
    repeat = seq.substr(F.lit(1), unit)
    spacer = seq.substr(unit + 1, loop)
    apr = F.col("family") == "APR"
    g_runs = S.tracts(seq, "G{2,}")
    stems = F.when(det == T.G4, F.when(F.size(g_runs) >= 2, g_runs).otherwise(F.slice(g_runs, 1, 0))).when(
        det == T.I_MOTIF, S.tracts(seq, "C{2,}")
    )
    anchor = F.when(det == T.G4, F.lit("G{2,}")).otherwise(F.lit("C{2,}"))
    gaps = F.split(F.regexp_replace(seq, anchor, F.lit("|")), r"\|")
    inner = F.filter(F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0))), lambda x: F.length(x) > 0)
    loops = F.when(F.size(stems) >= 2, inner).otherwise(F.slice(gaps, 1, 0))
    folded = (T.G4, T.I_MOTIF)
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
    mean = lambda parts: F.when(F.size(parts) > 0, S.total_length(parts) / F.size(parts))
    riz = F.substring(seq, 1, 1 << 30).substr(F.lit(1), unit)
    rez = seq.substr(F.col("rez_start") - F.col("start") + 1, F.col("rez_end") - F.col("rez_start"))
    a_runs, t_runs = S.tracts(seq, "A{3,}"), S.tracts(seq, "T{3,}")
    gc_total = gc_percent(seq)
    fields = {
        "tract_type": only(T.CURVED, F.when(count_of(seq, "A") > count_of(seq, "T"), "A-tract").otherwise("T-tract"), ~apr),
        "tract_length": only(T.CURVED, n, ~apr),
        "gc_content": only((T.CURVED, T.Z_DNA), gc_total),
        "at_content": only(T.CURVED, F.round(percent(count_of(seq, "AT"), n), 2)),
        "a_tracts": only(T.CURVED, a_runs, apr),
        "t_tracts": only(T.CURVED, t_runs, apr),
        "a_tract_lengths": only(T.CURVED, lengths(a_runs), apr),
        "t_tract_lengths": only(T.CURVED, lengths(t_runs), apr),
        "center_positions": F.col("centers"),
        "repeat_type": only(
            T.SLIPPED,
            F.when(is_str, F.concat(unit, F.lit("-mer STR"))).otherwise(
                F.concat(F.lit("Direct repeat ("), unit, F.lit(" bp unit, "), loop, F.lit(" bp spacer)"))
            ),
        ),
        "source": only(T.SLIPPED, F.lit("Wells 2005")),
        "unit_length": only(T.SLIPPED, unit),
        "repeat_unit": only(T.SLIPPED, repeat, is_str),
        "repeat_units": only(T.SLIPPED, F.col("copies")),
        "number_of_copies": only(T.SLIPPED, F.col("copies")),
        "unit_a_count": only(T.SLIPPED, count_of(repeat, "A"), is_str),
        "unit_t_count": only(T.SLIPPED, count_of(repeat, "T"), is_str),
        "unit_g_count": only(T.SLIPPED, count_of(repeat, "G"), is_str),
        "unit_c_count": only(T.SLIPPED, count_of(repeat, "C"), is_str),
        "gc_unit": only(T.SLIPPED, gc_percent(repeat)),
        "left_unit": only(T.SLIPPED, repeat, is_direct),
        "right_unit": only(T.SLIPPED, seq.substr(n - unit + 1, unit), is_direct),
        "spacer_length": only(T.SLIPPED, loop, is_direct),
        "spacer_sequence": only(T.SLIPPED, spacer, is_direct),
        "gc_spacer": only(T.SLIPPED, gc_percent(spacer), is_direct),
        "left_arm": only(has_arms, left, armed),
        "right_arm": only(has_arms, right, armed),
        "loop_seq": only(has_arms, loop_seq, armed),
        "arm_length": only(has_arms, arm, armed),
        "gc_left_arm": only(has_arms, gc_percent(left), armed),
        "gc_right_arm": only(has_arms, gc_percent(right), armed),
        "gc_loop": only(has_arms, gc_percent(loop_seq), armed),
        "mismatches": only(T.CRUCIFORM, F.lit(0)),
        "match_fraction": only(T.CRUCIFORM, F.lit(1.0)),
        "stems": only(folded, stems),
        "loops": only(folded, loops),
        "num_stems": only(folded, F.size(stems)),
        "num_loops": only(folded, F.size(loops)),
        "stem_lengths": only(folded, lengths(stems)),
        "loop_lengths": only(folded, lengths(loops)),
        "stem_length": F.when(det == T.CRUCIFORM, arm.cast("double")).otherwise(only(folded, mean(stems))),
        "loop_length": F.when(det.isin(*has_arms), loop.cast("double")).otherwise(only(folded, mean(loops))),
        "gc_total": only((T.SLIPPED, T.CRUCIFORM, T.G4, T.I_MOTIF), gc_total),
        "gc_stems": only(folded, F.when(F.size(stems) > 0, F.lit(100.0)).otherwise(F.lit(0.0))),
        "riz_start": only(T.R_LOOP, F.col("start") + 1),
        "riz_end": only(T.R_LOOP, F.col("start") + unit),
        "riz_length": only(T.R_LOOP, unit),
        "riz_sequence": only(T.R_LOOP, riz),
        "riz_g_percent": only(T.R_LOOP, F.col("raw")),
        "riz_g_total": only(T.R_LOOP, count_of(riz, "G")),
        "riz_3g_tracts": only(T.R_LOOP, F.size(S.tracts(riz, "G{3,}"))),
        "riz_4g_tracts": only(T.R_LOOP, F.size(S.tracts(riz, "G{4,}"))),
        "rez_start": F.col("rez_start"),
        "rez_end": F.col("rez_end"),
        "rez_length": only(T.R_LOOP, F.coalesce(F.col("rez_end") - F.col("rez_start"), F.lit(0))),
        "rez_sequence": only(T.R_LOOP, F.coalesce(rez, F.lit(""))),
        "rez_g_percent": only(T.R_LOOP, F.coalesce("rez_pct", F.lit(0.0))),
        "rez_g_total": only(T.R_LOOP, F.coalesce(count_of(rez, "G"), F.lit(0))),
        "rez_3g_tracts": only(T.R_LOOP, F.coalesce(F.regexp_count(rez, F.lit("G{3,}")), F.lit(0))),
        "rez_4g_tracts": only(T.R_LOOP, F.coalesce(F.regexp_count(rez, F.lit("G{4,}")), F.lit(0))),
        "linker_length": only(T.R_LOOP, F.coalesce(F.col("rez_start") - F.col("start") - unit, F.lit(0))),
        "contributing_10mers": F.col("n_hits"),
        "mean_10mer_score": only(T.Z_DNA, F.round(F.col("raw") / F.col("n_hits"), 6)),
        "cg_dinucleotides": only(T.Z_DNA, F.regexp_count(seq, F.lit("CG")) + F.regexp_count(seq, F.lit("GC"))),
        "at_dinucleotides": only(T.Z_DNA, F.regexp_count(seq, F.lit("AT")) + F.regexp_count(seq, F.lit("TA"))),
        "alternating_cg_regions": only(
            T.Z_DNA, F.regexp_count(seq, F.lit("(?:CG){2,}")) + F.regexp_count(seq, F.lit("(?:GC){2,}"))
        ),
        "alternating_at_regions": only(
            T.Z_DNA, F.regexp_count(seq, F.lit("(?:AT){2,}")) + F.regexp_count(seq, F.lit("(?:TA){2,}"))
        ),
        "motif_count": F.lit(None).cast("int"),
        "class_diversity": F.lit(None).cast("int"),
        "component_classes": F.lit(None).cast("array<string>"),
    }
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def candidates(source: DataFrame, detectors=ALL, chunk_len: int | None = None, text: bool = True) -> DataFrame:
    """Scored, gated candidates before overlap resolution (0-based half-open); without ``text``, arms have no ``seq``."""
    return scored(source, detectors, chunk_len, text=text).where(F.col("raw_score") > F.col("floor"))


def scored(source: DataFrame, detectors=ALL, chunk_len: int | None = None, every: bool = True, text: bool = True) -> DataFrame:
    return with_score(scan_candidates(source, tuple(detectors), chunk_len, every, text))


def with_score(rows: DataFrame) -> DataFrame:
    return rows.select("*", raw_score().alias("raw_score"), _floor().alias("floor"))


def reported() -> dict[str, Column]:
    """Class, subclass and score of a candidate as a motif shows them."""
    names = F.array(*[F.lit(x) for x in T.CLASS_NAMES])
    return {"class": F.element_at(names, F.col("det") + 1), "subclass": _subclass(), "score": S.decimals("raw_score", 3)}


def to_motifs(winners: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Candidate rows to motif rows: 1-based inclusive coordinates, names, details; columns ``more`` are kept."""
    shown = reported()
    methods = F.array(*[F.lit(x) for x in T.METHOD_NAMES])
    first = F.col("start") + 1
    return winners.select(
        "seq_id",
        F.concat_ws("_", "seq_name", _id_tag(), first).alias("id"),
        "seq_name",
        "seq_len",
        shown["class"].alias("class"),
        shown["subclass"].alias("subclass"),
        first.alias("start"),
        "end",
        (F.col("end") - F.col("start")).alias("length"),
        F.when(
            (F.col("det") == T.I_MOTIF) & (F.col("family") == "ac_motif_hur"), F.col("seq")
        ).otherwise(F.col("seq")).alias("sequence"),
        shown["score"].alias("score"),
        F.lit("+").alias("strand"),
        F.element_at(methods, F.col("det") + 1).alias("method"),
        _pattern_id().alias("pattern_id"),
        F.col("det").alias("det_order"),
        F.struct("chunk_start", "emit").alias("emit_order"),
        _details().alias("details"),
        *more,
    )


_SETTLING = ["seq_id", "chunk_start", "chunk_end", "seq_len", "start", "end", "raw_score", "floor", "grp", "slack", "reach", *ORDER_KEYS]


def select_winners(candidate_rows: DataFrame, detectors=ALL, columns: list[str] | None = None) -> DataFrame:
    """Gates and overlap resolution of freshly scanned candidates.

    Detectors that never reach across a clean cut are settled without any shuffle. The others
    leave a thin set of open rows at chunk borders; the settled table is written once so that
    splitting it does not repeat the scan. Of the candidate's own fields only ``columns`` travel, if given.
    """
    ordered = _with_order(candidate_rows)
    if columns is not None:
        ordered = ordered.select(*_SETTLING, *[c for c in columns if c not in _SETTLING])
    settled = settle_in_chunks(ordered)
    if not any(d in T.REACH for d in detectors):
        return settled
    table = materialize(settled)
    open_rows = resolve_open(table.where(~F.col("settled")))
    return table.where("settled").unionByName(open_rows)


def detect(sequences: DataFrame, detectors=ALL, chunk_len: int | None = None) -> DataFrame:
    """Sequences (seq_id, seq_name, bases) or chunk rows -> motifs, overlaps resolved."""
    return to_motifs(select_winners(scored(sequences, detectors, chunk_len, every=False), detectors))


def detect_places(sequences: DataFrame, detectors=ALL, chunk_len: int | None = None) -> DataFrame:
    """The motifs of ``detect`` without text and details: seq_id, class, subclass, start, end, length, score, det_order."""
    winners = select_winners(scored(sequences, detectors, chunk_len, every=False), detectors, ["det", "family"])
    shown = reported()
    return winners.select(
        "seq_id", shown["class"].alias("class"), shown["subclass"].alias("subclass"), (F.col("start") + 1).alias("start"), "end",
        (F.col("end") - F.col("start")).alias("length"), shown["score"].alias("score"), F.col("det").alias("det_order"),
    )
