"""Incremental FASTA ingestion: new files in a directory are analysed as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixmill.plans.pipelines import analyze
from helixmill.sources.fasta import file_columns, sequences_from_rows


def stream_fasta(spark: SparkSession, directory: str, out: str, checkpoint: str, flavour: str = "fast", trigger=None):
    """Detection is stateless per sequence, so each micro-batch is an ordinary batch run.

    A micro-batch holds whole files, so names are settled per file as in the batch reader: the
    last record of a repeated name counts. The batch id names the output partition; a replayed batch overwrites its own partition only,
    which makes the sink exactly-once.
    """
    records = spark.readStream.text(directory, lineSep="\n>").select("value", *file_columns())

    def run(batch, batch_id):
        motifs = analyze(sequences_from_rows(batch), flavour)
        motifs.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
