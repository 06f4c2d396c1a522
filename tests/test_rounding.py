"""Motif scores on the edge of a decimal are rounded as their SQL rounds them."""

import duckdb

from helixmill import tables as T
from helixmill.operators import motifs as M
from helixmill.operators.scan import CANDIDATE_SCHEMA

# (riz percent, rez percent, rez start, rez end) of r-loops met in documents
EDGES = [(80.95, 75.0, 1744, 1844), (51.85, 46.0, 12071, 12121), (61.54, 44.86, 4695, 5045), (78.95, 42.0, 16121, 16171), (50.0, 40.0, 100, 150)]


def test_scores_on_the_edge_equal_sql(spark):
    names = [f.split()[0] for f in CANDIDATE_SCHEMA.split(", ")]
    rows = []
    for n, (raw, percent, start, end) in enumerate(EDGES):
        row = {"seq_id": n, "seq_name": "s", "seq_len": 20000, "chunk_start": 0, "chunk_end": 20000, "det": T.R_LOOP, "family": "qmrlfs_model_1"}
        row |= {"emit": 0, "start": start - 60, "end": end, "seq": "G" * (end - start + 60), "unit": 20, "raw": raw}
        row |= {"rez_start": start, "rez_end": end, "rez_pct": percent}
        rows.append(tuple(row.get(name) for name in names))
    scored = spark.createDataFrame(rows, CANDIDATE_SCHEMA).withColumn("raw_score", M.raw_score())
    found = {r.seq_id: r.score for r in M.to_motifs(scored).select("seq_id", "score").collect()}
    for n, (raw, percent, start, end) in enumerate(EDGES):
        zone = f"CAST({percent} AS DOUBLE) * ({end} - {start}) / CAST(100.0 AS DOUBLE)"
        sql = f"SELECT round(CAST({raw} AS DOUBLE) / CAST(100.0 AS DOUBLE) + ({zone}) / CAST(100.0 AS DOUBLE), 3)"
        assert found[n] == duckdb.sql(sql).fetchall()[0][0]
