"""Statistics over motif tables (seq_id, class, subclass, start, end, length, score).

Coordinates are 1-based inclusive. Lengths of sequences come as a (seq_id, seq_len) table.
Means and deviations are returned unrounded; ``rounded`` applies the reporting precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import sequence as Q
from helixmill.operators.islands import covered_length
from helixmill.operators.quantiles import percentiles
from helixmill.session import materialize

OVERALL = "Overall"


def base_stats(sequences: DataFrame) -> DataFrame:
    """Length, base counts, GC, AT and melting temperature per sequence."""
    upper = F.upper("bases")
    return sequences.where(F.length("bases") > 0).select(
        "seq_id",
        F.length("bases").alias("length"),
        *[Q.count_of(upper, b).alias(f"n_{b.lower()}") for b in "ATGCN"],
        F.round(Q.gc_content("bases"), 2).alias("gc_percent"),
        F.round(Q.at_content("bases"), 2).alias("at_percent"),
        F.round(Q.melting_temperature("bases"), 1).alias("tm"),
    )


def coverage(motifs: DataFrame, keys: list[str]) -> DataFrame:
    """Unique covered bases per key."""
    return covered_length(motifs, keys, F.col("start") - 1, F.col("end"))


def _with_length(df: DataFrame, lengths: DataFrame) -> DataFrame:
    return df.join(lengths.select("seq_id", "seq_len"), "seq_id")


def genomic_density(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Covered percent of each sequence, per class and Overall, capped at 100."""
    by_class = coverage(motifs, ["seq_id", "class"])
    overall = coverage(motifs, ["seq_id"]).select("seq_id", F.lit(OVERALL).alias("class"), "covered")
    share = F.least(F.col("covered") * 100.0 / F.col("seq_len"), F.lit(100.0))
    return _with_length(by_class.unionByName(overall), lengths).select(
        "seq_id", "class", F.round(share, 4).alias("density_percent")
    )


_UNITS = {"bp": 1.0, "kbp": 1_000.0, "Mbp": 1_000_000.0}


def positional_density(motifs: DataFrame, lengths: DataFrame, unit: str = "Mbp") -> DataFrame:
    """Motifs per unit of length, per class and Overall, from one rollup."""
    counts = motifs.rollup("seq_id", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    rows = counts.where("g < 3").select("seq_id", F.when(F.col("g") == 1, OVERALL).otherwise(F.col("class")).alias("class"), "n")
    scale = F.col("n") / (F.col("seq_len") / _UNITS[unit])
    return _with_length(rows, lengths).select("seq_id", "class", F.round(scale, 2).alias("density"))


def density_table(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per class the three densities side by side."""
    parts = [
        genomic_density(motifs, lengths),
        positional_density(motifs, lengths, "kbp").withColumnRenamed("density", "per_kbp"),
        positional_density(motifs, lengths, "Mbp").withColumnRenamed("density", "per_mbp"),
    ]
    return reduce(lambda a, b: a.join(b, ["seq_id", "class"]), parts)


MILLION = 1_000_000


def exact_mean(total: Column, n: Column, unit: int, digits: int) -> Column:
    """total / n / unit rounded half up, from integers only, so that it does not depend on the order of summing."""
    scale = 10**digits
    part = (F.lit(2 * scale) * total + n * unit).cast("decimal(38,0)") / (n * (2 * unit)).cast("decimal(20,0)")
    return F.floor(part).cast("double") / scale


def exact_deviation(total: Column, squares: Column, n: Column, unit: int) -> Column:
    """Population deviation from exact integer sums."""
    return F.sqrt((n.cast("decimal(12,0)") * squares - total * total).cast("double")) / n / unit


def motif_statistics(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per sequence; sequences without motifs appear with zeros.

    Means and deviations come from exact sums (scores in millionths), rounded last.
    """
    score = F.round(F.col("score") * MILLION).cast("decimal(18,0)")
    size = F.col("length").cast("decimal(18,0)")
    sums = {
        "_s": F.sum(score), "_ss": F.sum((score * score).cast("decimal(28,0)")),
        "_l": F.sum(size), "_ll": F.sum((size * size).cast("decimal(28,0)")), "_n": F.count("score"),
    }
    whole = {name: value.cast("decimal(38,0)" if name in ("_ss", "_ll") else "decimal(18,0)") for name, value in sums.items()}
    per_seq = motifs.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("total_motifs"),
        F.countDistinct("class").alias("classes_detected"),
        F.countDistinct("subclass").alias("subclasses_detected"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.min("length").alias("length_min"),
        F.max("length").alias("length_max"),
        *[value.alias(name) for name, value in whole.items()],
    )
    n, total = F.col("_n"), F.col("total_motifs")
    per_seq = per_seq.select(
        "*",
        exact_mean(F.col("_s"), n, MILLION, 3).alias("score_mean"),
        exact_deviation(F.col("_s"), F.col("_ss"), n, MILLION).alias("score_std"),
        exact_mean(F.col("_l"), total, 1, 1).alias("length_mean"),
        exact_deviation(F.col("_l"), F.col("_ll"), total, 1).alias("length_std"),
    )
    joined = (
        lengths.select("seq_id", "seq_len")
        .join(per_seq, "seq_id", "left")
        .join(coverage(motifs, ["seq_id"]), "seq_id", "left")
        .na.fill(0, ["total_motifs", "classes_detected", "subclasses_detected", "covered"])
    )
    positive = F.col("seq_len") > 0
    return joined.select(
        "seq_id",
        "total_motifs",
        F.when(positive, F.round(F.col("covered") * 100.0 / F.col("seq_len"), 2)).otherwise(0.0).alias("coverage_percent"),
        F.when(positive, F.round(F.col("total_motifs") / (F.col("seq_len") / 1000), 2)).otherwise(0.0).alias("density_per_kb"),
        "classes_detected",
        "subclasses_detected",
        "score_mean",
        *[F.round(c, 3).alias(c) for c in ("score_std", "score_min", "score_max")],
        "length_mean",
        F.round("length_std", 1).alias("length_std"),
        "length_min",
        "length_max",
    )


def distribution(motifs: DataFrame, by: str = "class") -> DataFrame:
    return motifs.groupBy("seq_id", by).agg(F.count(F.lit(1)).alias("n"))


def enhanced_statistics(motifs: DataFrame, lengths: DataFrame, enrichment: DataFrame | None = None) -> dict[str, DataFrame]:
    out = {
        "basic": motif_statistics(motifs, lengths),
        "genomic_density": genomic_density(motifs, lengths),
        "positional_density_per_kbp": positional_density(motifs, lengths, "kbp"),
        "positional_density_per_mbp": positional_density(motifs, lengths, "Mbp"),
    }
    return out if enrichment is None else {**out, "enrichment": enrichment}


def sequence_summary(motifs: DataFrame) -> DataFrame:
    """Totals and means per sequence; also serves the run summary (average score, class count)."""
    return motifs.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("total_motifs"),
        F.countDistinct("class").alias("classes_detected"),
        F.countDistinct("subclass").alias("subclasses_detected"),
        F.round(F.avg("score"), 3).alias("score_mean"),
        F.round(F.avg("length"), 1).alias("length_mean"),
    )


def scan_summary(motifs: DataFrame) -> DataFrame:
    return motifs.agg(
        F.count(F.lit(1)).alias("total_motifs"),
        F.countDistinct("class").alias("classes_detected"),
        F.countDistinct("subclass").alias("subclasses_detected"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
    )


def run_config(motifs: DataFrame) -> DataFrame:
    """One row: classes seen, number of sequences, number of motifs."""
    return motifs.agg(
        F.sort_array(F.collect_set("class")).alias("classes"),
        F.countDistinct("seq_id").alias("n_sequences"),
        F.count(F.lit(1)).alias("n_motifs"),
    )


def summary_table(sequences: DataFrame, motifs: DataFrame) -> DataFrame:
    """Per sequence: length, GC, totals, coverage, density, distinct classes."""
    lengths = sequences.select("seq_id", F.length("bases").alias("seq_len"))
    stats = motif_statistics(motifs, lengths).select(
        "seq_id", "total_motifs", "coverage_percent", "density_per_kb", "classes_detected", "subclasses_detected"
    )
    return base_stats(sequences).select("seq_id", F.col("length").alias("length_bp"), "gc_percent").join(stats, "seq_id")


def genome_summary(motifs: DataFrame, lengths: DataFrame, classes: list[str]) -> DataFrame:
    """One row per genome with a count column per class; lengths are true lengths."""
    counts = motifs.groupBy("genome").pivot("class", classes).agg(F.count(F.lit(1))).na.fill(0)
    totals = motifs.groupBy("genome").agg(F.count(F.lit(1)).alias("total_motifs"), F.countDistinct("class").alias("unique_classes"))
    bp = lengths.groupBy("genome").agg(F.sum("seq_len").alias("length_bp"))
    return bp.join(totals, "genome").join(counts, "genome").withColumn(
        "motifs_per_kb", F.col("total_motifs") / F.col("length_bp") * 1000
    )


def class_summary(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("length"), 1).alias("avg_length"),
        F.round(F.avg("score"), 3).alias("avg_score"),
    )


def class_tree(motifs: DataFrame) -> DataFrame:
    """Counts of class, subclass and total from one rollup."""
    return motifs.rollup("class", "subclass").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def value_distribution(motifs: DataFrame, value: str) -> DataFrame:
    """n, mean, quartiles, deviation and range of score or length per class.

    A class is never gathered in one task: moments are summed before the shuffle, quartiles come from ``percentiles``.
    """
    values = materialize(motifs.select("class", value))
    moments = values.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    quartiles = percentiles(values, "class", value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quartiles, "class", "left").select("class", "n", "mean", "q1", "median", "q3", "std", "min", "max")


def histogram(motifs: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram per class over that class's own range."""
    limits = motifs.groupBy("class").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        motifs.join(F.broadcast(limits), "class")  # one row per class
        .groupBy("class", slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heatmap(motifs: DataFrame, lengths: DataFrame, window: int = 1000) -> DataFrame:
    """Motifs per class and equal-width bin; a motif counts in every bin it overlaps.

    Empty (class, bin) cells of a sequence are filled with zero.
    """
    sized = lengths.select("seq_id", "seq_len", F.greatest(F.lit(1), F.floor(F.col("seq_len") / window)).alias("bins"))
    width = F.col("seq_len") / F.col("bins")
    placed = motifs.drop("seq_len").join(sized, "seq_id").withColumn(
        "bin",
        F.explode(
            F.sequence(
                F.greatest(F.lit(0), F.floor(F.col("start") / width)).cast("int"),
                F.least(F.col("bins") - 1, F.ceil(F.col("end") / width) - 1).cast("int"),
            )
        ),
    )
    inside = (F.col("end") > F.col("bin") * width) & (F.col("start") < (F.col("bin") + 1) * width)
    counted = placed.where(inside).groupBy("seq_id", "class", "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = (
        motifs.select("seq_id", "class").distinct().join(sized, "seq_id")
        .select("seq_id", "class", F.explode(F.sequence(F.lit(0), (F.col("bins") - 1).cast("int"))).alias("bin"))
    )
    return cells.join(counted, ["seq_id", "class", "bin"], "left").na.fill(0, ["n"])


def class_matrix(motifs: DataFrame, lengths: DataFrame, statistic: str = "count") -> DataFrame:
    """seq_id x class table of count, coverage or density."""
    if statistic == "count":
        tidy, value = distribution(motifs), "n"
    elif statistic == "coverage":
        tidy, value = genomic_density(motifs, lengths).where(F.col("class") != OVERALL), "density_percent"
    else:
        tidy, value = positional_density(motifs, lengths, "kbp").where(F.col("class") != OVERALL), "density"
    return tidy.groupBy("seq_id").pivot("class").agg(F.first(value)).na.fill(0)
