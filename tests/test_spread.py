"""Texts are spread before bases are derived, by their size; detector results are scanned once."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from helixmill import session
from helixmill.plans import queries
from helixmill.sources.fasta import dna_from_documents


def documents(folder, n=60):
    table = {"doc_id": range(n), "text": [f"Some words of text {i}" for i in range(n)], "source": ["web"] * n}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), f"{folder}/documents.parquet")
    return str(folder)


def test_one_row_group_is_derived_by_many_tasks(spark, tmp_path, monkeypatch):
    folder = documents(tmp_path)
    cores = spark.sparkContext.defaultParallelism
    rows = dna_from_documents(spark, folder)
    assert rows.rdd.getNumPartitions() == 4 * cores
    assert sorted(r.seq_id for r in rows.collect()) == list(range(60))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("translate") < plan.index("Repartition")
    monkeypatch.setattr(session, "TASK_BYTES", 16)
    assert dna_from_documents(spark, folder).rdd.getNumPartitions() > 4 * cores


def test_detector_results_read_one_scan(spark, tmp_path):
    plan = queries._merged_results(spark, documents(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_task_reads_about_a_megabyte_at_any_size(spark, tmp_path):
    def tasks(mb):
        folder = tmp_path / str(mb)
        folder.mkdir()
        texts = [os.urandom(50_000).hex() for _ in range(mb * 10)]
        pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "source": ["web"] * len(texts)}), folder / "documents.parquet")
        size = os.path.getsize(folder / "documents.parquet")
        return size / dna_from_documents(spark, str(folder)).rdd.getNumPartitions()

    assert tasks(24) < 1.5e6 and tasks(72) < 1.5e6
