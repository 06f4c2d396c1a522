"""pattern_counts scans every registry class, and so does its SQL."""

import re
from collections import Counter

import duckdb

from helixmill import catalogs
from helixmill.plans.oracles import ORACLES
from helixmill.plans.queries import QUERIES
from helixmill.sources.fasta import dna_from_documents

TEXTS = ["the quick brown fox jumps over the lazy dog " * 3, "aaaaaaaaaa gggggggg aaaaccccc", "banana banana cacacaca tgtgtgtg " * 5, "kggg acc " * 30, "x9 y"]


def test_no_class_is_left_out(spark, tmp_path):
    rows = [(n, "web", text) for n, text in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    texts = [r.bases for r in dna_from_documents(spark, str(tmp_path)).collect()]
    patterns, hits = Counter(), Counter()
    for row in catalogs.rows("registry"):
        patterns[row[1]] += 1
        hits[row[1]] += sum(1 for bases in texts for _ in re.finditer(row[3], bases))
    want = sorted((c, n, hits[c]) for c, n in patterns.items() if hits[c])
    assert {"slipped_dna", "cruciform", "curved_dna", "g_quadruplex"} <= {c for c, *_ in want}
    assert sorted(map(tuple, QUERIES["pattern_counts"](spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").fetchall()
    assert sorted(con.execute(ORACLES["pattern_counts"]).fetchall()) == want
