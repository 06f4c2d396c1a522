"""Operators against brute force, the library, or held-out labels."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helixmill.llm import language, near_dedup, packing, pii, token_counts, toxicity
from helixmill.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = ["", "a", "'s't're'll'LL x's ''s '", " 's", "x  's", "\n's", "a\n\n b \n", "İSTANBUL ΑΣ ΣΑΣ", "éá", "a\x1cb\x85c d　e",
       "<|endoftext|>hi<|startoftext|> x<|endoftext|", "12 345 ½ ٣", "😀😀 日本語テスト", "a" * 900, " \n\t ", "don't can't we'll I'm", "a\u0000b",
       "ab " * 2000]


def mixed(n, seed=1):
    r = random.Random(seed)
    signs = ["a", "'s", "'", " ", "\n", "re", "ll", "1", "!", "é", "\t", "　", "The", "ß"]
    return ["".join(r.choice(signs) for _ in range(40)) for _ in range(n)]


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), ODD + mixed(400)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path).texts(texts).tolist() == want


def test_packed_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ODD + mixed(400)
    for text, ids in zip(texts, packing.Encoder(path).texts(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_token_is(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "ENCODE_BYTES", 300)
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 300)
    text = "Some words, and a line\n here  and there; don't stop. " * 80
    assert packing.Encoder(path).texts([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    words = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.Counter(words).texts([text])[0] == len(Tokenizer.from_file(words).encode(text, add_special_tokens=False).ids)


def test_every_id_lies_in_one_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(docs).toPandas()
    for row in docs.limit(40).collect():
        ids = [*library.encode(row.text, add_special_tokens=False).ids, 0]
        mine = found[found.doc_id == row.doc_id].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and mine.length.sum() == len(ids)
        for start, size, crc in zip(mine.start, mine.length, mine.ids_crc32):
            assert crc == zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
    assert found.length.sum() / (found.sequence_id.nunique() * 1024) > 0.97


def test_first_fit_decreasing_equals_the_plain_rule():
    r = random.Random(4)
    for _ in range(50):
        sizes = sorted((r.randint(1, 64) for _ in range(r.randint(1, 80))), reverse=True)
        bins, want = [], []
        for size in sizes:
            place = next((n for n, used in enumerate(bins) if used + size <= 64), len(bins))
            if place == len(bins):
                bins.append(0)
            want.append((place, bins[place]))
            bins[place] += size
        assert list(zip(*packing.first_fit_decreasing(sizes, 64))) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    texts = ["".join(r.choice("aZ09.@+- _%(12345") for _ in range(60)) for _ in range(8000)]
    texts += ["4111 1111 1111 1111 and 4111-1111-1111-1112", "a@b.c_x@y.z", "256.1.1.1 1.2.3.4.5", "9" * 6000, "+1 (555) 010-9999"]
    for text in texts:
        want = [("email", *m.span()) for m in EMAIL.finditer(text)]
        want += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        found = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE]
        assert found == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert [s[0] for s in pii.find_spans("my bank account GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert [s[0] for s in pii.find_spans("social security 123-45-6789")] == ["ssn"] and pii.find_spans("order 123-45-6789") == []
    assert pii.mask("mail a@b.co now", pii.find_spans("mail a@b.co now")) == "mail [EMAIL] now"


@pytest.mark.parametrize("number", ["AT61 1904 3002 3457 3201", "ES9121000418450200051332", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32"])
@pytest.mark.parametrize("after", ["", " BIC", " I", " 12", " ABCD 1234", ", DE", " DE89 3704 0044 0532 0130 00"])
def test_account_numbers_end_where_their_country_says(number, after):
    found = [s[1:3] for s in pii.find_spans("account XX12 " + number + after) if s[0] == "iban"]
    assert found[0] == (13, 13 + len(number)) and len(found) == 1 + ("DE89" in after)


def near_tables(spark, seed=2):
    """Groups of near copies around the threshold, chains, hot passages and short texts."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 5, 12, 60, 150]))]
        for _ in range(r.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(90)]
    for n in range(0, 70, 7):
        texts.append(chain[n:] + [word() for _ in range(n)])
    texts += [passage + [word() for _ in range(r.choice([5, 10, 30, 80]))] for _ in range(120)]
    r.shuffle(texts)
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def classes(rows):
    sets = {}
    for n, text in rows:
        words = text.split()
        sets[n] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    parent = {n: n for n in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in sets}, sets


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    if small:  # reach the paths of large buckets
        for name, value in (("LEADERS", 2), ("BLOCK_ROWS", 8)):
            monkeypatch.setattr(near_dedup, name, value)
    rows, docs = near_tables(spark)
    want, sets = classes(rows)
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in found)


def test_repeated_ids_follow_their_texts(spark):
    """An id on a unique text and on a copy, two ids on texts of two components, and a row repeated often."""
    word = lambda seed: [f"w{seed}_{n}" for n in range(60)]
    changed = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, d, e = (word(n) for n in range(5))
    rows = [(3, " ".join(a), 1), (5, " ".join(a), 2), (5, " ".join(b), 3), (7, " ".join(c), 4), (7, " ".join(d), 5), (8, changed(c), 6), (9, changed(d), 7)]
    rows += [(2, " ".join(e), 8)] * 20 + [(2, changed(e), 9), (1, changed(b), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(4)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert {x[:1] + x[2:] for x in found if x[0] in (3, 5, 1)} == {(3, 3, True), (5, 3, False), (5, 1, False), (1, 1, True)}
    left = sorted(r.row for r in near_dedup.drop_near_copies(docs).collect())
    assert left in ([1, 4, 5, 8, 10], [1, 4, 5, 9, 10])


def test_index_finds_every_pair_within_the_radius():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 16, near_dedup.SLOTS, dtype=np.uint16)
        b = a.copy()
        wrong = r.choice(near_dedup.SLOTS, near_dedup.RADIUS, replace=False)
        b[wrong] ^= np.uint16(1)
        keys = near_dedup.index_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(100, 160)] + [(1, n) for n in range(2, 60)]
    random.Random(1).shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{n: 100 for n in range(100, 161)}, **{n: 1 for n in range(1, 60)}}


def test_components_over_many_blocks(spark, monkeypatch):
    """Links that are contracted in several tasks need the star steps; null ends and loops are no links."""
    r = random.Random(7)
    links = [(r.randrange(3000), r.randrange(3000)) for _ in range(1400)] + [(5000 + n, 5000) for n in range(1, 700)] + [(6000 + n, 6001 + n) for n in range(200)]
    r.shuffle(links)
    label = {n: n for link in links for n in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    monkeypatch.setattr("helixmill.llm.components.BLOCK_LINKS", 50)
    rows = [*links, (None, 1), (2, None), (9, 9)]
    found = components(spark.createDataFrame(rows, "a long, b long").repartition(16)).collect()
    assert len(found) == len(label) and {r.node: r.component for r in found} == label


def test_language_on_held_out_rows(spark):
    found = language.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [(r.lang, r.lang_pred) for r in found.where("held_out").collect()]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95


def test_pairs_of_terms_are_learnt():
    """Labels that are 1 only when two terms meet: additive weights cannot tell them."""
    r = np.random.default_rng(3)
    sets, labels = [], []
    for _ in range(4000):
        a, b = (r.random(2) < 0.5).tolist()
        sets.append(np.array([0] * a + [1] * b + [2 + r.integers(6)], np.int64))
        labels.append(float(a == b))
    machine = toxicity.FactorizationMachine(8)
    machine.fit(sets, np.array(labels), epochs=30)
    rows, terms = np.repeat(np.arange(4000), [len(s) for s in sets]), np.concatenate(sets)
    assert ((machine.scores(rows, terms, 4000) >= 0.5) == np.array(labels)).mean() > 0.95


def test_pairs_of_terms_reach_the_machine(spark):
    """The same labels through learn() and score(): neither term tells alone, and both are rarer than many others."""
    r, rows = random.Random(5), []
    for n in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = ["insult"] * a + ["group"] * b + [f"w{k}" for k in range(40) if r.random() < 0.7]
        rows.append((n, " ".join(words), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.learn(docs.where("doc_id < 2400").select("doc_id", "text"), docs.select("doc_id", "toxic"))
    found = toxicity.score(docs.select("doc_id", "text"), model).join(docs, "doc_id").where("doc_id >= 2400").collect()
    assert sum((x.score >= 0.5) == bool(x.toxic) for x in found) / len(found) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    found = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) / len(found) > 0.93


def test_pipeline_runs_all_stages(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {r.doc_id for r in packed}
    assert 100 < len(ids) < len(docs) and ids <= set(docs)
    kept = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")).collect()}
    assert all(i == c for i, c in kept.items())


def test_first_shared_key_is_the_first_equal_one():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 16, near_dedup.SLOTS, dtype=np.uint16)
    rows = np.tile(a, (300, 1))
    for row in rows:
        row[r.choice(near_dedup.SLOTS, r.integers(0, 40), replace=False)] ^= np.uint16(3)
    same = near_dedup.index_keys(rows) == near_dedup.index_keys(a[None])
    want = np.where(same.any(axis=1), same.argmax(axis=1), -1)
    assert near_dedup.first_shared(rows, a).tolist() == want.tolist()
