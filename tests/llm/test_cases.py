"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import decontaminate, language, near_dedup, packing, pii, sharding, token_counts, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, spans string, _key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long_text = " ".join(prose(n, 200) for n in range(1000, 1120))
    rows = [
        (1, prose(1), "en", "a"), (2, prose(1), "en", "a"), (3, prose(1) + " tail", "en", "a"), (4, prose(4), "de", "b"),
        (5, None, None, None), (6, "", "en", "a"), (7, "   \n\t", "fr", "b"), (None, prose(9), "en", None),
        (None, prose(1), None, "a"), (10, "Idiot one two", "en", "b"), (10, "Idiot one two", "en", "b"), (11, "one two three", "en", "b"),
        (12, long_text, "es", "a"), (13, "é" * 3000, "fr", "a"), (14, "12345 !!", None, "a"), (10, "other text of ten", "en", "b"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "y", "z") for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (10, 0, 1), (10, 1, 0), (None, 0, 1), (4, 1, None), (3, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int"
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(docs, nothing):
    found = token_counts.count_tokens(docs).collect()
    assert len(found) == docs.count() and token_counts.count_tokens(nothing).count() == 0
    by = {(r.doc_id, r.n_bytes): r.n_tokens for r in found}
    assert by[(5, 0)] == by[(6, 0)] == 0 and by[(7, 5)] == 0 and by[(13, 6000)] > 0


def test_packing(docs, nothing):
    assert packing.pack(nothing).count() == 0
    found = packing.pack(docs, group_pieces=8).toPandas()
    assert len(found[found.doc_id == 5]) == 1 and int(found[found.doc_id == 5].length.iloc[0]) == 1
    assert found[found.doc_id.isna()].shape[0] == 2
    for _, part in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 1024


def test_language(docs, nothing):
    assert language.predict(nothing, None).count() == 0 and language.learn(nothing) is None
    unknown = language.predict(docs, None).collect()
    assert {r.lang_pred for r in unknown} == {"und"} and {r.score for r in unknown} == {0.0}
    found = language.predict(docs, language.learn(docs)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (5, 6, 7, 14)} == {"und"}


def test_pii(docs, nothing):
    assert pii.find_pii(nothing).count() == 0 and pii.mask_pii(nothing).count() == 0
    found = pii.find_pii(docs).collect()
    assert len(found) == docs.count() and all(r.spans == [] for r in found)
    assert rows(pii.mask_pii(docs), *docs.columns) == rows(docs, *docs.columns)


def test_toxicity(docs, nothing, labels, spark):
    assert toxicity.learn(nothing, labels) is None and toxicity.score(nothing, None).count() == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    empty_labels = spark.createDataFrame([], labels.schema)
    assert toxicity.learn(docs, empty_labels) is None
    found = toxicity.score(docs, toxicity.learn(docs, labels, min_docs=1)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)


def test_sharding(docs, nothing):
    assert sharding.assign_shards(nothing).count() == 0
    found = sharding.assign_shards(docs, shards=5, bucket_rows=3).toPandas()
    assert len(found) == docs.count() and sorted(found.groupby("shard").size()) == [3, 3, 3, 3, 4]
    assert all(sorted(p) == list(range(len(p))) for _, p in found.groupby("shard").slot)
    assert int(found[found.doc_id == 5]["size"].iloc[0]) == 8 and int(found[found.doc_id == 5].text_crc32.iloc[0]) == 0


def test_written_shards_hold_every_row(docs, spark, tmp_path):
    assigned = sharding.assign_shards(docs, shards=3)
    sharding.write_shards(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows(back, *docs.columns) == rows(docs, *docs.columns)


def test_near_duplicates(docs, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert (by[2].component_id, by[2].kept, by[3].component_id) == (1, False, 1)
    assert (by[5].n_shingles, by[6].n_shingles, by[7].n_shingles) == (0, 0, 0) and by[7].component_id == 7 and by[5].kept
    assert by[11].n_shingles == 1 and by[13].component_id == 13
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and {2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_decontamination(docs, nothing, spark):
    items = spark.createDataFrame(
        [(1, prose(4, 12), "q"), (1, prose(4, 12), "q"), (2, None, "q"), (3, "", "q"), (None, prose(1, 20), "q"), (4, "one TWO three", "q")],
        "item_id long, text string, spans string",
    )
    none = spark.createDataFrame([], items.schema)
    assert decontaminate.mark_contaminated(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.mark_contaminated(docs, none).collect())
    marks = decontaminate.mark_contaminated(docs, items).collect()
    assert len(marks) == docs.count()
    assert {(r.doc_id, r.first_item) for r in marks if r.contaminated} == {(4, 1), (11, 4)}
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\n1", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é" * 40000),
             (None, "http://e", "<p>x</p>"), (6, "http://f", "y"), (6, "http://f", "y")]
    table = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, refers_to string")
    warc.write_warc(table, str(tmp_path / "w"))
    found = warc.read_warc(spark, str(tmp_path / "w"))
    by = {r.page_id: r for r in found.collect() if r.page_id not in (None, 6)}
    assert found.count() == len(pages) and found.where("page_id = 6 and record_type = 'response'").count() == 2
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[4].refers_to) == ("response", "revisit", 1, 3)
    assert bytes(by[5].payload).decode() == "é" * 40000 and all(r.digest_ok for r in by.values() if r.record_type == "response")
    assert by[3].payload_digest == base64.b32encode(hashlib.sha1(b"").digest()).decode() and by[3].target_uri is None
    assert found.where("page_id is null").first().refers_to == 1
    some = found.where((F.col("record_type") == "revisit") & F.col("page_id").isin(2, 4))
    assert {r.page_id for r in some.collect()} == {2, 4}
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("payload is not null").count() == 0
    warc.write_warc(table.where("page_id = -1"), str(tmp_path / "empty"))
    assert warc.read_warc(spark, str(tmp_path / "empty")).count() == 0


def test_warc_reader_skips_what_predicates_refuse(tmp_path):
    data = b"".join(warc.record_bytes(n, "http://x", b"page %d" % n, 0 if n % 2 else None) for n in range(6))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / warc.MANIFEST).write_text(f'[["a.warc", {len(data)}]]')
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("page_id",), (2, 3, 4)), "other"]))
    assert left == ["other"]
    got = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert [(r["page_id"], r["payload"]) for r in got] == [(2, b"page 2"), (4, b"page 4")]


def test_topk(spark):
    random.seed(5)
    table = [(n, [random.uniform(-1, 1) for _ in range(6)]) for n in range(300)]
    table += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6)]
    table += [(305, table[7][1]), (306, table[7][1]), (306, table[7][1]), (307, [0.5, 0.5]), (350, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<float>, score int")
    vectors = topk.integer_vectors(frame)
    whole = {r.vec_id: r.vec for r in vectors.collect()}
    assert set(whole) == {*range(300), 305, 306, 307, 350}
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), lane_rows=90, group_queries=3).collect()
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == want
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.where("vec_id < 0")).count() == 0
    assert len(topk.top_k(vectors.where("vec_id in (0, 1)"), vectors.where("vec_id = 0")).collect()) == 1


def test_stages_keep_columns_and_take_edge_cases(docs, nothing, labels, spark, tmp_path):
    spark.createDataFrame([(1, prose(4, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, nothing):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        ids = {r.doc_id for r in packed.collect()}
        assert ids == ({1, 5, 6, 7, None, 10, 11, 12, 13, 14} if table is docs else set()), name


def test_crc_is_the_one_of_the_text(docs):
    found = sharding.assign_shards(docs).where("doc_id = 13").first()
    assert found.text_crc32 == zlib.crc32(("é" * 3000).encode())
