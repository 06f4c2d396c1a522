"""Sequence sources. All return (seq_id, seq_name, source, bases, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.session import spread


def _identified(df: DataFrame) -> DataFrame:
    """Adds seq_id: the file's whole path, if there is one, with the name, and the number of a nameless record."""
    path = F.col("path") if "path" in df.columns else F.col("source")
    return df.select(
        F.xxhash64(path, "seq_name").alias("seq_id"),
        "seq_name",
        "source",
        "bases",
        F.length("bases").alias("length"),
    )


def _placed(records: DataFrame) -> DataFrame:
    """One row per record with its place: path, start of the file split, row in it, part of the row."""
    for name, value in (("path", F.col("source")), ("block", F.lit(0).cast("long"))):
        if name not in records.columns:
            records = records.withColumn(name, value)
    inner = F.split("value", r"\n[ \t\r\f]*>")  # headers that are indented do not end a row of the reader
    return records.withColumn("row", F.monotonically_increasing_id()).select(
        "source", "path", "block", "row", F.posexplode(inner).alias("part", "value")
    )


_PLACE = ["block", "row", "part"]


def parse_records(records: DataFrame, dialect: str = "file", last_wins: bool = False) -> DataFrame:
    """(value, source) rows, one FASTA record each with or without ``>``, to named sequences.

    ``file`` strips and upper-cases lines; ``upload`` keeps case, strips only line ends and names
    nameless records ``Seq{n}``. Records without bases are dropped. A nameless record is numbered
    by the different names before it in its file: names are counted per file split, and splits are
    summed up in order, so the number does not depend on how a file is split. With ``last_wins``
    a repeated name within a file keeps its last record; generated names repeat nothing.
    """
    placed = records if "part" in records.columns else _placed(records)
    body = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), r"\r$", ""))
    rest = F.regexp_replace(body, r"^[^\n]*\n?", "")
    lines = F.regexp_replace(rest, r"[ \t\r\f]*(\n|$)[ \t\r\f]*", "")
    bases = F.upper(F.trim(lines)) if dialect == "file" else F.trim(lines)
    named = placed.select("source", "path", *_PLACE, header.alias("header"), bases.alias("bases")).where(F.length("bases") > 0)

    # only names and places travel; what is joined back is one row per nameless or beaten record
    thin = named.select("path", "header", *_PLACE)
    place = F.struct(*_PLACE)
    seen = thin.where("header <> ''").groupBy("path", "header").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("copies")
    )
    events = seen.select("path", "first.*", F.lit(False).alias("nameless")).unionByName(
        thin.where("header = ''").select("path", *_PLACE, F.lit(True).alias("nameless"))
    )
    per_block = events.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("path", "block").orderBy("row", "part")
    numbers = events.withColumn("in_block", F.row_number().over(order)).where("nameless").join(offsets, ["path", "block"])
    numbers = numbers.select("path", *_PLACE, (F.col("offset") + F.col("in_block")).alias("number"))
    if last_wins:
        beaten = thin.join(seen.where("copies > 1").select("path", "header", "last"), ["path", "header"])
        named = named.join(beaten.where(place < F.col("last")).select("path", *_PLACE), ["path", *_PLACE], "left_anti")
    prefix = "sequence_" if dialect == "file" else "Seq"
    name = F.when(F.col("header") == "", F.concat(F.lit(prefix), F.col("number").cast("string"))).otherwise(F.col("header"))
    return named.join(numbers, ["path", *_PLACE], "left").select("source", "path", name.alias("seq_name"), "bases")


def file_columns() -> list:
    """What a text reader says about the origin of a row."""
    origin = {"source": "file_name", "path": "file_path", "block": "file_block_start"}
    return [F.col(f"_metadata.{field}").alias(name) for name, field in origin.items()]


def read_fasta(spark: SparkSession, path: str, dialect: str = "file", last_wins: bool = True) -> DataFrame:
    """FASTA file, glob or directory. One record is one row; files are split by the text reader.

    Files are told apart by their whole path; ``source`` is the file name. Text before the first
    header of a file is no record.
    """
    return sequences_from_rows(spark.read.text(path, lineSep="\n>").select("value", *file_columns()), dialect, last_wins)


def sequences_from_rows(records: DataFrame, dialect: str = "file", last_wins: bool = True) -> DataFrame:
    """Sequences from the rows of a text reader with ``file_columns``, of a batch or a micro-batch of whole files."""
    placed = _placed(records)
    heads = placed.groupBy("path").agg(F.min(F.struct(*_PLACE)).alias("head"))
    loose = placed.where("block = 0 and part = 0").where(~F.col("value").rlike(r"^\s*>")).select("path", *_PLACE)
    loose = loose.join(heads, "path").where(F.struct(*_PLACE) == F.col("head")).select("path", *_PLACE)
    placed = placed.join(loose, ["path", *_PLACE], "left_anti")
    return _identified(parse_records(placed, dialect, last_wins))


def read_genomes(spark: SparkSession, directory: str) -> DataFrame:
    """Every ``*.fasta`` of a directory, tagged with the file stem as ``genome``."""
    return read_fasta(spark, f"{directory.rstrip('/')}/*.fasta").withColumn(
        "genome", F.regexp_extract("source", r"(.*)\.fasta$", 1)
    )


def sequences_from_dict(spark: SparkSession, sequences: dict[str, str]) -> DataFrame:
    rows = [(name, bases) for name, bases in sequences.items()]
    df = spark.createDataFrame(rows, "seq_name string, bases string").withColumn("source", F.lit("memory"))
    return _identified(df)


def sequences_from_text(spark: SparkSession, text: str, dialect: str = "upload") -> DataFrame:
    """Pasted FASTA text."""
    rows = [(part,) for part in ("\n" + text.strip()).split("\n>")[1:]]
    df = spark.createDataFrame(rows, "value string").withColumn("source", F.lit("pasted"))
    return _identified(parse_records(df.coalesce(1), dialect))


def dna_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA derived from the whole text of ``documents``: letters become bases, and a motif that
    depends on the document number is appended, so that every detector meets real positives.

    Texts are spread over the cores before bases are derived from them."""
    insert = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_INSERTS]), (F.col("doc_id") % 13 + 1).cast("int"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    bases = F.concat(F.translate(letters, FIXTURE_LETTERS, FIXTURE_BASES), insert)
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return documents.select(
        F.col("doc_id").alias("seq_id"),
        F.concat(F.lit("doc_"), "doc_id").alias("seq_name"),
        F.col("source"),
        bases.alias("bases"),
    )


FIXTURE_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIXTURE_BASES = "ACGTACGTACGTACGTACGTACGTAC"
FIXTURE_INSERTS = [
    "GGGTTAGGGTTAGGGTTAGGG",
    "CCCTAACCCTAACCCTAACCC",
    "CGCGCGCGCGCGCG",
    "TAGGGGGGGGGT",
    "AAAAATGCGCGAAAAATGCGCGAAAAATGCGCG",
    "TTTTTTTTTT",
    "CACACACACACACACACACA",
    "ACGTTGCAGGCATCATTTACGTTGCAGGCATCA",
    "ATCGGCTATTTTTAGCCGAT",
    "GAAGGAGAAGTCGAAGAGGAAG",
    "GAAGAAGAAGAAGAAGAAG",
    "AAATTGCCCCTTGACCCTTGACCC",
    "",
]
