"""Queries over whole catalogs against plain regular expressions on a small table."""

import re
from collections import Counter, defaultdict

import pytest

from helixmill import catalogs
from helixmill.plans.queries import QUERIES
from helixmill.sources.fasta import dna_from_documents

TEXTS = ["the quick brown fox jumps over the lazy dog " * 3, "aaaaaaaaaa gggggggg aaaaccccc", None, "", "x9 y", "banana banana cacacaca tgtgtgtg " * 2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(n, "web", text) for n, text in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").where("text is not null").write.parquet(f"{path}/documents.parquet")
    return path


def texts(spark, folder):
    return {r.seq_id: r.bases for r in dna_from_documents(spark, folder).collect()}


def test_all_seeds(spark, folder):
    want = Counter()
    for seq_id, bases in texts(spark, folder).items():
        for name, regex, seed, _, _, det in catalogs.SEEDS:
            for m in re.finditer(regex, bases):
                want[seq_id, det, str(seed), name, m.start() + 1, m.end()] += 1
    found = Counter(map(tuple, QUERIES["seed_hits"](spark, folder).collect()))
    assert found == want and any(key[2] == "6" for key in want)


def test_every_registry_class(spark, folder):
    hits, seqs, total, patterns = Counter(), defaultdict(set), Counter(), Counter()
    for row in catalogs.rows("registry"):
        patterns[row[1]] += 1
        for seq_id, bases in texts(spark, folder).items():
            for m in re.finditer(row[3], bases, re.I):
                hits[row[1]] += 1
                total[row[1]] += m.end() - m.start()
                seqs[row[1]].add(seq_id)
    found = {r["class"]: (r.n_patterns, r.n_hits, r.n_sequences, r.bases) for r in QUERIES["registry_counts"](spark, folder).collect()}
    assert found == {c: (n, hits[c], len(seqs[c]), total[c]) for c, n in patterns.items()}
    assert len(found) == 9
