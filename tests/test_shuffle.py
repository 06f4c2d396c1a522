"""Shuffled copies keep the order of md5(salt_position) and are made once per enrichment."""

import hashlib

from helixmill.operators import enrichment as E
from pyspark.sql import functions as F

TEXTS = [(1, "s1", "ACGTNACGTTTGCA" * 9), (2, "s2", ""), (3, "s3", None), (4, "s4", "A"), (5, "s5", "ggccaattN")]


def _sequences(spark):
    return spark.createDataFrame(TEXTS, "seq_id bigint, seq_name string, bases string")


def test_order_is_that_of_the_hashes(spark):
    rows = {(r.origin_id, r.iteration): r.bases for r in E.shuffle_sequences(_sequences(spark), 2).collect()}
    for seq_id, _, bases in TEXTS:
        for n in range(2):
            place = lambda at: hashlib.md5(f"42_{seq_id}_{n}_{at}".encode()).hexdigest()  # noqa: E731, B023
            want = bases and "".join(bases.upper()[at] for at in sorted(range(len(bases)), key=place))
            assert rows[(seq_id, n)] == want


def test_enrichment_shuffles_once(spark):
    shuffles = spark.sparkContext.accumulator(0)

    def detect(sequences):
        def count(batches):
            for batch in batches:
                shuffles.add(batch.num_rows)
                yield batch

        seen = sequences.select("seq_id", "bases").mapInArrow(count, "seq_id bigint, bases string")
        return seen.where("length(bases) > 3").select("seq_id", F.lit("X").alias("class"), F.lit(1).alias("start"), F.lit(3).alias("end"))

    rows = E.enrichment(_sequences(spark), detect, n_shuffles=3).collect()
    assert {(r.seq_id, r["class"]) for r in rows} == {(s, c) for s in (1, 5) for c in ("X", "Overall")}
    assert all(r.p_value == 1.0 and r.observed_count == 1 for r in rows)
    assert shuffles.value == 4 * len(TEXTS)  # the sequences and three copies, each scanned once
