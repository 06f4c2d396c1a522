"""Detection report and motif quality check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill import tables as T


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(n, name, sub) for n, name, subs in T.TAXONOMY for sub in subs]
    return spark.createDataFrame(rows, "class_no int, class string, subclass string")


def expected(spark: SparkSession) -> DataFrame:
    rows = [(n, c, s) for n, (c, subs) in enumerate(T.EXPECTED_SUBCLASSES.items()) for s in subs]
    return spark.createDataFrame(rows, "ord int, class string, subclass string")


def _renamed(column: str, names: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(pairs[F.col(column)], F.col(column)).alias(column)


def detection_report(motifs: DataFrame, strict_names: bool = False) -> DataFrame:
    """Per expected class: status, count, detected and missing subclasses.

    ``strict_names`` compares names literally, so classes that are emitted under another
    spelling print as not detected; by default emitted names are mapped to the expected ones.
    """
    if not strict_names:
        motifs = motifs.select(_renamed("class", T.REPORT_CLASS_ALIASES), _renamed("subclass", T.REPORT_SUBCLASS_ALIASES))
    want = expected(motifs.sparkSession)
    seen = motifs.groupBy("class", "subclass").agg(F.count(F.lit(1)).alias("n"))
    per_class = seen.groupBy("class").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_set("subclass")).alias("detected")
    )
    missing = (
        want.where(~F.col("subclass").isin("Dynamic overlaps", "Dynamic clusters"))
        .join(seen, ["class", "subclass"], "left_anti")
        .groupBy("class")
        .agg(F.sort_array(F.collect_set("subclass")).alias("absent"))
    )
    classes = want.groupBy("class").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("expected_subclasses"), F.sort_array(F.collect_set("subclass")).alias("all_subclasses"))
    found = F.col("n").isNotNull()
    return (
        classes.join(per_class, "class", "left")
        .join(missing, "class", "left")
        .select(
            "ord",
            "class",
            F.when(found, "DETECTED").otherwise("NOT_DETECTED").alias("status"),
            F.coalesce("n", F.lit(0)).alias("count"),
            "expected_subclasses",
            F.coalesce(F.array_join("detected", "; "), F.lit("")).alias("detected_subclasses"),
            F.when(found, F.coalesce(F.array_join("absent", "; "), F.lit("")))
            .otherwise(F.array_join("all_subclasses", "; "))
            .alias("missing_subclasses"),
        )
    )


def detection_summary(motifs: DataFrame, strict_names: bool = False) -> DataFrame:
    rows = detection_report(motifs, strict_names)
    total = len(T.EXPECTED_SUBCLASSES)
    return rows.agg(
        F.count(F.lit(1)).alias("total_classes"),
        F.sum((F.col("status") == "DETECTED").cast("int")).alias("detected_classes"),
        F.sum((F.col("status") != "DETECTED").cast("int")).alias("missing_classes"),
        F.sum("count").alias("total_motifs"),
    ).withColumn("detection_rate", F.format_string("%.1f%%", F.col("detected_classes") / total * 100))


def report_lines(motifs: DataFrame, strict_names: bool = False) -> DataFrame:
    """The report as ordered text lines (a few dozen rows)."""
    rows = detection_report(motifs, strict_names)
    head = detection_summary(motifs, strict_names).select(
        F.lit(-1).alias("ord"),
        F.lit("").alias("class"),
        F.explode(
            F.array(
                F.lit("NON-B DNA MOTIF DETECTION REPORT"),
                F.concat(F.lit("Total Classes: "), "total_classes"),
                F.concat(F.lit("Detected Classes: "), "detected_classes"),
                F.concat(F.lit("Not Detected Classes: "), "missing_classes"),
                F.concat(F.lit("Total Motifs: "), "total_motifs"),
                F.concat(F.lit("Detection Rate: "), "detection_rate"),
            )
        ).alias("value"),
    )
    body = rows.select(
        F.when(F.col("status") == "DETECTED", F.col("ord")).otherwise(F.col("ord") + 100).alias("ord"),
        "class",
        F.when(
            F.col("status") == "DETECTED",
            F.concat_ws("", "class", F.lit(" ("), "count", F.lit(" motifs): "), "detected_subclasses", F.lit(" | missing: "), "missing_subclasses"),
        )
        .otherwise(F.concat(F.lit("NOT DETECTED "), "class", F.lit(": expected "), "missing_subclasses"))
        .alias("value"),
    )
    return head.unionByName(body).orderBy("ord", "class", "value")


def quality_issues(motifs: DataFrame) -> DataFrame:
    """One row per (motif, issue): missing fields, bad coordinates, lengths, same-class overlap.

    A motif overlaps a later one of its class when the next start lies before its end, so one
    look at the following row per (sequence, class) replaces the pair search.
    """
    required = ["class", "subclass", "start", "end", "sequence"]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    truthy = lambda *cs: [F.coalesce(F.col(c), F.lit(0)) != 0 for c in cs]
    s, e, n = truthy("start", "end", "length")
    ahead = Window.partitionBy("seq_id", "class").orderBy("start", "end")
    rules = F.array(
        F.when(missing != "", F.concat(F.lit("Missing fields: "), missing)),
        F.when(s & e & (F.col("start") >= F.col("end")), F.lit("Invalid coordinates (start >= end)")),
        F.when(s & e & n & (F.col("end") - F.col("start") + 1 != F.col("length")), F.lit("Length inconsistent with coordinates")),
        F.when((F.coalesce(F.col("sequence"), F.lit("")) != "") & n & (F.length("sequence") != F.col("length")), F.lit("Sequence length doesn't match reported length")),
        F.when(F.col("next_start") < F.col("end"), F.lit("Overlapping motifs in class")),
    )
    looked = motifs.withColumn("next_start", F.lead("start").over(ahead))
    return looked.select("seq_id", "class", "start", "end", F.explode(F.array_compact(rules)).alias("issue"))


def quality_report(motifs: DataFrame, show: int = 10) -> DataFrame:
    """One row: totals, status and the first issues (ten, as a report feature)."""
    issues = quality_issues(motifs)
    shown = issues.orderBy("seq_id", "start", "issue").limit(show).agg(F.collect_list("issue").alias("issues"))
    counted = issues.agg(F.count(F.lit(1)).alias("issues_found"))
    total = motifs.agg(F.count(F.lit(1)).alias("total_motifs"))
    n = F.col("issues_found")
    return total.join(counted, F.lit(True)).join(shown, F.lit(True)).select(
        "total_motifs",
        "issues_found",
        (n == 0).alias("passed"),
        F.when(n == 0, F.lit("PASSED")).otherwise(F.concat(F.lit("FAILED ("), n, F.lit(" issues)"))).alias("status"),
        "issues",
    )
