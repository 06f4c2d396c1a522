"""From raw documents to packed training sequences: five stages, each a table of documents for the next.

1. toxicity: rows that the factorization machine, learnt from ``labels``, scores 0.5 or more go.
2. near_dedup: one document of each group of near copies stays.
3. decontamination: documents that contain a benchmark item go.
4. pii: personal data in the text is replaced by its kind.
5. packing: the remaining texts as pieces in sequences of 1024 ids.

Every stage works on all rows its predecessor kept and returns the columns it was given, but the
last, which returns the packed pieces. Rows with null text are kept by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, near_dedup, packing, pii, toxicity
from helixmill.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: the models and the packing cannot be written in SQL; tests hold the stages against plain versions
ORACLE_SQL = None
