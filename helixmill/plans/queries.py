"""The registered queries: every operator over the DNA derived from the whole documents table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill import catalogs, tables as T
from helixmill.functions import scoring as S
from helixmill.functions import sequence as Q
from helixmill.operators import charts, composite, filters, report, stats
from helixmill.operators import enrichment as E
from helixmill.operators import summaries
from helixmill.operators import mismatches
from helixmill.operators import motifs as M
from helixmill.operators.islands import merge_intervals
from helixmill.operators.nearest import nearest_join
from helixmill.operators.overlap import select_non_overlapping
from helixmill.operators.repeats import a_tract_windows, called_windows, direct_repeats, inverted_repeats, kmer_pairs, mirror_repeats, phased_windows, tandem_repeats, tenmer_regions
from helixmill.operators.scan import scan_patterns
from helixmill.plans import pipelines as P
from helixmill.session import materialize
from helixmill.sources import sinks
from helixmill.sources.fasta import dna_from_documents, parse_records

# (class, pattern id, subclass, regex): a plain motif table both engines can derive
PROBES = [
    ("Curved_DNA", "P1", "Local Curvature", "A{7,}|T{7,}"),
    ("R-Loop", "P2", "R-loop formation sites", "G{3,}[ACGT]{5,50}C{3,}"),
    ("Triplex", "P3", "Triplex", "[GA]{10,}"),
    ("Triplex", "P4", "Sticky DNA", "(?:GAA){4,}"),
    ("G-Quadruplex", "P5", "Relaxed G4", catalogs.G4_FAMILIES[1][1]),
    ("i-Motif", "P6", "Canonical i-motif", catalogs.CANONICAL_I_MOTIF[1]),
    ("Z-DNA", "P7", "eGZ", "[CG]{6,}"),
    ("A-philic_DNA", "P8", "A-philic DNA", "A{6,}"),
]


def dna(spark: SparkSession, sf: str) -> DataFrame:
    return dna_from_documents(spark, sf)


def lengths(spark, sf) -> DataFrame:
    return dna(spark, sf).select("seq_id", F.length("bases").alias("seq_len"))


def probe_motifs(spark: SparkSession, sf: str) -> DataFrame:
    hits = scan_patterns(dna(spark, sf), PROBES)
    n = F.length("sequence")
    return hits.select(
        "seq_id", "seq_name", "seq_len", "class", "subclass", "start", "end", n.cast("bigint").alias("length"), "sequence",
        (n / (n + 6.0)).alias("score"), F.lit("+").alias("strand"), F.lit("scan").alias("method"), F.col("ord").alias("det_order"),
        "pattern_id",
    )


def motifs_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same motifs as a table, for queries that read them more than once: one scan of the texts."""
    return materialize(probe_motifs(spark, sf))


def _seq_stats(spark, sf):
    return stats.base_stats(dna(spark, sf))


def _sequence_flags(spark, sf):
    return dna(spark, sf).select(
        "seq_id",
        Q.validation_message("bases").alias("message"),
        Q.is_valid("bases").alias("ok"),
        Q.is_palindrome("bases").alias("palindrome"),
        F.md5(Q.reverse_complement("bases")).alias("revcomp_md5"),
        F.md5(Q.revcomp("bases")).alias("acgt_revcomp_md5"),
        F.md5(Q.normalise("bases")).alias("dna_md5"),
        F.md5(Q.wrap("bases")).alias("wrapped_md5"),
        Q.shortened("bases").alias("short"),
    )


def _fasta_lines(spark, sf):
    return sinks.fasta_lines(dna(spark, sf)).select(F.md5("value").alias("record_md5"))


def _fasta_records(spark, sf):
    records = sinks.fasta_lines(dna(spark, sf)).withColumn("source", F.lit("memory"))
    return parse_records(records).select("seq_name", F.length("bases").alias("n"), F.md5("bases").alias("bases_md5"))


def _library_scores(spark, sf):
    exact = {k: v for k, v in S.SCORES.items() if k not in ("instability_score", "cruciform_stability", "g4hunter_score")}
    m = probe_motifs(spark, sf).withColumn("g4", S.g4hunter("sequence"))
    return m.select("seq_id", "class", "subclass", "start", F.round("g4", 6).alias("g4hunter_score"), *[F.round(f("sequence"), 6).alias(k) for k, f in exact.items()])


def _legacy_scores(spark, sf):
    m = probe_motifs(spark, sf)
    return m.select(
        "seq_id", "class", "subclass", "start",
        F.round(S.legacy_g4hunter("sequence"), 6).alias("g4"),
        F.round(S.legacy_curvature("sequence"), 6).alias("curvature"),
        F.round(S.legacy_z_dna("sequence"), 6).alias("z_dna"),
        F.round(S.legacy_triplex("sequence"), 6).alias("triplex"),
    )


def _arrow_scores(spark, sf):
    m = probe_motifs(spark, sf)
    return m.select(
        "seq_id", "class", "subclass", "start",
        F.round(S.instability_score("sequence"), 6).alias("instability"),
        F.round(S.cruciform_stability("sequence"), 6).alias("cruciform_stability"),
        F.round(S.direct_repeat_score("sequence"), 6).alias("direct_repeat"),
    )


def _pattern_scan(rows):
    return lambda spark, sf: scan_patterns(dna(spark, sf), rows).select("seq_id", "pattern_id", "start", "end")


def family(prefix: str) -> list[tuple]:
    return [(r[1], r[4], r[6], r[3]) for r in catalogs.rows("detector") if r[1] == prefix and r[3]]


def _catalog_table(name):
    return lambda spark, sf: _hits_per_pattern(scan_patterns(dna(spark, sf), [(r[1], r[4], r[6], r[3]) for r in catalogs.rows(name)]))


def _hits_per_pattern(hits):
    return hits.groupBy("class", "pattern_id", "subclass").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("bases"))


def _candidates(det):
    def run(spark, sf):
        rows = M.candidates(dna(spark, sf), (det,), text=False)
        return rows.select("seq_id", "family", (F.col("start") + 1).alias("start"), "end", F.round("raw_score", 6).alias("score"))

    return run


def _detector(*dets):
    def run(spark, sf):
        return M.detect(dna(spark, sf), dets).select("seq_id", "class", "subclass", "start", "end", "length", "score")

    return run


def _rez(spark, sf):
    rows = M.candidates(dna(spark, sf), (T.R_LOOP,))
    return rows.select(
        "seq_id", F.col("family").alias("model"), (F.col("start") + 1).alias("riz_start"), (F.col("start") + F.col("unit")).alias("riz_end"),
        F.col("raw").alias("riz_g_percent"), "rez_start", "rez_end", F.col("rez_pct").alias("rez_g_percent"),
    )


def _ranked(m):
    return m.withColumn("rank_key", F.col("det_order"))


def _hybrids(spark, sf):
    pairs = composite.overlap_pairs(_ranked(motifs_once(spark, sf)), 0.3, 1.0, False)
    return pairs.select("seq_id", "class_1", "class_2", "start", "end", F.round("mean_score", 6).alias("score"))


def _legacy_hybrids(spark, sf):
    pairs = composite.overlap_pairs(_ranked(motifs_once(spark, sf)), 0.3, 0.7, True)
    return pairs.select("seq_id", "class_1", "class_2", "start", "end", F.round("mean_score", 6).alias("score"))


def _clusters(spark, sf):
    weighted = _ranked(probe_motifs(spark, sf)).withColumn("score", F.col("length").cast("double"))
    rows = composite.clusters(weighted, "modular")
    return rows.select("seq_id", "subclass", "start", "end", "motif_count", "class_diversity", "score")


def _selected(spark, sf):
    kept = select_non_overlapping(materialize(probe_motifs(spark, sf)), [], [-F.col("score"), -F.col("length"), F.col("det_order"), F.col("start")], slack=0)
    return kept.select("seq_id", "class", "subclass", "start", "end")


def _merged(spark, sf):
    m = materialize(probe_motifs(spark, sf).select("seq_id", (F.col("start") - 1).alias("s"), F.col("end").alias("e")))
    return merge_intervals(m, ["seq_id"], "s", "e")


def _coverage(spark, sf):
    return stats.coverage(probe_motifs(spark, sf), ["seq_id", "class"])


def _stat(fn):
    return lambda spark, sf: fn(probe_motifs(spark, sf))


def _stat_len(fn, *args):
    return lambda spark, sf: fn(motifs_once(spark, sf), lengths(spark, sf), *args)


def _summary_table(spark, sf):
    return stats.summary_table(dna(spark, sf), motifs_once(spark, sf))


def _value_distribution(value):
    def run(spark, sf):
        d = stats.value_distribution(probe_motifs(spark, sf), value)
        return d.select("class", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q1", "median", "q3", "std", "min", "max")])

    return run


def _source_summary(spark, sf):
    """The genome comparison with document sources as genomes."""
    names = dna(spark, sf).select("seq_id", F.col("source").alias("genome"), F.length("bases").alias("seq_len"))
    m = motifs_once(spark, sf).drop("seq_len").join(names.select("seq_id", "genome"), "seq_id")
    s = stats.genome_summary(m, names, sorted({p[0] for p in PROBES}))
    return s.withColumn("motifs_per_kb", F.round("motifs_per_kb", 6)).toDF(*[c.replace("-", "_") for c in s.columns])


def _filters(spark, sf):
    m = probe_motifs(spark, sf)
    kept = filters.by_length(filters.by_score(filters.by_class(m, ["Z-DNA", "Triplex"]), 0.6), 12, 40)
    return kept.select("seq_id", "class", "subclass", "start", "end")


def _bed(spark, sf):
    return sinks.bed_rows(probe_motifs(spark, sf))


def _gff3(spark, sf):
    return sinks.gff3_rows(probe_motifs(spark, sf).withColumn("score", F.lit(None).cast("double")))


def _export(spark, sf):
    m = probe_motifs(spark, sf).withColumn("id", F.concat_ws("_", "seq_name", "pattern_id", "start")).withColumn("score", F.lit(None).cast("double"))
    return sinks.export_frame(m)


def _display(spark, sf):
    return filters.display_rows(probe_motifs(spark, sf).withColumn("score", F.lit(None).cast("double")))


def _canonical(spark, sf):
    m = probe_motifs(spark, sf).select(
        F.col("class").alias("Type"), F.nullif("subclass", F.lit("eGZ")).alias("Subtype"), F.col("start").alias("Start"), F.col("end").alias("End"),
        F.when(F.col("length") > 20, F.col("length")).alias("Length"), F.round("score", 6).alias("ActualScore"), F.col("seq_name").alias("sequence_name"), F.col("sequence").alias("matched_seq"),
    )
    return filters.canonicalize(m)


def _shuffle(spark, sf):
    s = E.shuffle_sequences(dna(spark, sf), 1)
    return s.select(F.col("origin_id"), "iteration", F.md5("bases").alias("bases_md5"))


def _probe_density(seqs):
    hits = scan_patterns(seqs, [PROBES[2], PROBES[6]])
    return hits.select("seq_id", "class", "start", "end")


def _enrichment(spark, sf):
    rows = E.enrichment(dna(spark, sf), _probe_density, n_shuffles=3)
    return charts.enrichment_panel(rows).select(
        "seq_id", "class", "observed_density", "background_mean", "background_std", F.col("fold_for_chart"), "p_value", "observed_count", "significance"
    )


def _enrichment_detectors(spark, sf):
    """All detectors and composites against 100 shuffled copies of every sequence."""
    return charts.enrichment_panel(P.permutation_enrichment(dna(spark, sf)))


def _nearest_windows(spark, sf):
    """For every motif the called A/T window whose middle is closest to its own, by twice the middles."""
    middle = (F.col("start") + F.col("end")).alias("middle")
    m = materialize(probe_motifs(spark, sf).select("seq_id", "pattern_id", "start", "end", middle))
    windows = materialize(called_windows(dna(spark, sf)).select("*", middle))
    return nearest_join(m, windows, ["seq_id"], "middle", distinct=True).drop("near_middle")


def _pipeline(flavour):
    def run(spark, sf):
        return P.analyze(dna(spark, sf), flavour).select("seq_id", "seq_name", "class", "subclass", "start", "end", "length", "score")

    return run


def _details(spark, sf):
    m = P.analyze(dna(spark, sf), "fast")
    return sinks.csv_frame(m)


def _patterns(spark, sf):
    """Catalog counts next to what each pattern class finds in the documents."""
    registry = catalogs.catalog(spark, "registry")
    found = scan_patterns(dna(spark, sf), [(r[1], r[4], r[6], r[3]) for r in catalogs.rows("registry")])
    hits = found.groupBy("class").agg(F.count(F.lit(1)).alias("n_hits"))
    return catalogs.pattern_counts(registry).join(hits, "class")


def _registry_counts(spark, sf):
    """Every registry class: its patterns next to what they find, zero where nothing is found."""
    registry = catalogs.catalog(spark, "registry")
    hits = scan_patterns(dna(spark, sf), registry).groupBy("class").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("seq_id").alias("n_sequences"), F.sum(F.col("end") - F.col("start") + 1).alias("bases")
    )
    patterns = catalogs.pattern_counts(registry).where("class <> 'total'")
    return patterns.join(hits, "class", "left").na.fill(0, ["n_hits", "n_sequences", "bases"])


def _all_seed_hits(spark, sf):
    return P.seed_hits(dna(spark, sf)).select("seq_id", "class", "pattern_id", "subclass", "start", "end")


def _g4_counts(spark, sf):
    """Flagship slice: scan, motif rows, count and mean length by class."""
    m = P.analyze(dna(spark, sf), "fast")
    return m.groupBy("class", "subclass").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 3).alias("avg_length"))


def _raw_locations(spark, sf):
    return P.raw_locations(dna(spark, sf), PROBES).drop("pattern_key")


def _top_hits(spark, sf):
    best = Window.partitionBy("seq_id").orderBy(F.desc("length"), "start", "pattern_id")
    return probe_motifs(spark, sf).withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("seq_id", "rank", "class", "start", "end")


def _seed_hits(spark, sf):
    simple = [(d, str(sid), name, rx) for name, rx, sid, _, _, d in catalogs.SEEDS if sid != 6]
    return scan_patterns(dna(spark, sf), simple).select("seq_id", "pattern_id", "start", "end")


def _quality(spark, sf):
    m = probe_motifs(spark, sf).withColumn("length", F.when(F.col("det_order") == 3, F.col("length") + 1).otherwise(F.col("length")))
    return report.quality_issues(m).groupBy("class", "issue").agg(F.count(F.lit(1)).alias("n"))


def _kmer_pairs(spark, sf):
    return kmer_pairs(dna(spark, sf), T.INVERTED_SEED, T.INVERTED_SEED, T.INVERTED_SEED + T.INVERTED_MAX_LOOP)


def _analyze_seeded(spark, sf):
    return P.analyze(dna(spark, sf), "seeded").select("seq_id", "class", "subclass", "start", "end", "score", "seed_start", "seed_end")


def _mismatched_repeats(spark, sf):
    return mismatches.mismatched_repeats(dna(spark, sf)).drop("seq_name", "seq_len", "chunk_start", "chunk_end")


def _mismatched_cruciforms(spark, sf):
    return mismatches.mismatched_cruciforms(dna(spark, sf)).drop("chunk_start", "chunk_end")


def _detector_scores(*dets):
    def run(spark, sf):
        parts = [summaries.detector_scores(dna(spark, sf), det) for det in dets]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.withColumn("score", F.round("score", 4))

    return run


def _contributing(spark, sf):
    rows = summaries.contributing_tenmers(dna(spark, sf), T.Z_DNA)
    return rows.withColumn("score", F.round("score", 4))


def _strict(spark, sf):
    m = probe_motifs(spark, sf)
    kept = summaries.resolve_across_classes(m, order=[F.col("det_order"), F.col("start")])
    return kept.select("seq_id", "class", "subclass", "start", "end")


def _merged_results(spark, sf):
    m = motifs_once(spark, sf)
    parts = {c: m.where(F.col("class") == c) for c in sorted({p[0] for p in PROBES})}
    merged = summaries.merge_detector_results(parts, "hybrid")
    return merged.groupBy("detector", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bases"))


def _composite_summary(spark, sf):
    ranked = materialize(_ranked(probe_motifs(spark, sf).withColumn("score", F.col("length").cast("double"))))
    pairs = composite.overlap_pairs(ranked, 0.3, 1.0, False)
    pairs = pairs.select(F.lit(T.HYBRID).alias("class"), (F.col("end") - F.col("start")).alias("length"))
    return summaries.composite_summary(pairs.unionByName(composite.clusters(ranked, "modular").select("class", "length")))


QUERIES = {
    "detector_scores": _detector_scores(T.Z_DNA, T.A_PHILIC, T.G4, T.R_LOOP, T.I_MOTIF),
    "detector_scores_curved": _detector_scores(T.CURVED),
    "validated_i_motifs": lambda s, d: summaries.validated_i_motifs(dna(s, d), reverse=True),
    "contributing_tenmers": _contributing,
    "resolve_across_classes": _strict,
    "merge_detector_results": _merged_results,
    "composite_summary": _composite_summary,
    "run_config": _stat(stats.run_config),
    "score_bins": _stat(lambda m: stats.histogram(m.withColumn("score", F.round(F.col("score") * 1_000_000).cast("long")), "score")),
    "seq_stats": _seq_stats,
    "sequence_flags": _sequence_flags,
    "fasta_lines": _fasta_lines,
    "fasta_round_trip": _fasta_records,
    "library_scores": _library_scores,
    "legacy_scores": _legacy_scores,
    "arrow_scores": _arrow_scores,
    "scan_g_quadruplex": _pattern_scan(family("g_quadruplex")),
    "scan_i_motif": _pattern_scan(family("i_motif")),
    "scan_r_loop": _pattern_scan(family("r_loop")),
    "scan_triplex": _pattern_scan(family("triplex")),
    "scan_registry": _catalog_table("registry"),
    "scan_legacy": _catalog_table("legacy"),
    "scan_seeds": _seed_hits,
    "seed_hits": _all_seed_hits,
    "pattern_counts": _patterns,
    "registry_counts": _registry_counts,
    "raw_locations": _raw_locations,
    "long_tracts": _candidates(T.CURVED),
    "nearest_windows": _nearest_windows,
    "phased_windows": lambda s, d: phased_windows(dna(s, d)),
    "a_tract_windows": lambda s, d: a_tract_windows(dna(s, d)),
    "z_dna_regions": lambda s, d: tenmer_regions(dna(s, d), T.Z_DNA),
    "a_philic_regions": lambda s, d: tenmer_regions(dna(s, d), T.A_PHILIC),
    "tandem_repeats": lambda s, d: tandem_repeats(dna(s, d)),
    "direct_repeats": lambda s, d: direct_repeats(dna(s, d)),
    "inverted_repeats": lambda s, d: inverted_repeats(dna(s, d)),
    "mirror_repeats": lambda s, d: mirror_repeats(dna(s, d)),
    "inverted_seed_pairs": _kmer_pairs,
    "r_loop_zones": _rez,
    "g4_candidates": _candidates(T.G4),
    "imotif_candidates": _candidates(T.I_MOTIF),
    "triplex_candidates": _candidates(T.TRIPLEX),
    "g4_motifs": _detector(T.G4),
    "imotif_motifs": _detector(T.I_MOTIF),
    "curved_motifs": _detector(T.CURVED),
    "z_dna_motifs": _detector(T.Z_DNA, T.A_PHILIC),
    "slipped_motifs": _detector(T.SLIPPED),
    "cruciform_motifs": _detector(T.CRUCIFORM),
    "analyze_seeded": _analyze_seeded,
    "mismatched_repeats": _mismatched_repeats,
    "mismatched_cruciforms": _mismatched_cruciforms,
    "r_loop_motifs": _detector(T.R_LOOP),
    "triplex_motifs": _detector(T.TRIPLEX),
    "select_non_overlapping": _selected,
    "merge_intervals": _merged,
    "hybrid_pairs": _hybrids,
    "hybrid_pairs_legacy": _legacy_hybrids,
    "cluster_windows": _clusters,
    "coverage": _coverage,
    "genomic_density": _stat_len(stats.genomic_density),
    "positional_density": _stat_len(stats.positional_density, "kbp"),
    "density_table": _stat_len(stats.density_table),
    "motif_statistics": _stat_len(stats.motif_statistics),
    "sequence_summary": _stat(stats.sequence_summary),
    "summary_table": _summary_table,
    "class_summary": _stat(stats.class_summary),
    "class_tree": _stat(stats.class_tree),
    "subclass_breakdown": lambda s, d: charts.subclass_breakdown(motifs_once(s, d)),
    "top_classes": _stat(charts.top_classes),
    "coverage_track": _stat_len(charts.coverage_track),
    "length_distribution": _value_distribution("length"),
    "score_distribution": _value_distribution("score"),
    "score_histogram": lambda s, d: stats.histogram(motifs_once(s, d), "length"),
    "density_heatmap": _stat_len(stats.heatmap),
    "genome_summary": _source_summary,
    "scan_summary": _stat(lambda m: stats.scan_summary(m).withColumn("avg_score", F.round("avg_score", 6))),
    "detection_report": _stat(report.detection_report),
    "quality_issues": _quality,
    "filters": _filters,
    "top_hits": _top_hits,
    "bed_rows": _bed,
    "gff3_rows": _gff3,
    "export_frame": _export,
    "display_rows": _display,
    "canonicalize": _canonical,
    "shuffle": _shuffle,
    "enrichment": _enrichment,
    "analyze_fast_summary": _g4_counts,
    "analyze_fast_csv": _details,
    "analyze_standard": _pipeline("standard"),
    "analyze_modular": _pipeline("modular"),
    "analyze_legacy": _pipeline("legacy"),
    "enrichment_detectors": _enrichment_detectors,
}
