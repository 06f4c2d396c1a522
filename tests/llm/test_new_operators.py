"""Token files, fill-in-the-middle and token alignment against plain versions, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helixmill.llm import fill_in_middle as fim
from helixmill.llm import token_alignment, token_files
from helixmill.llm.spaced import SpacedWords
from helixmill.llm.token_counts import byte_symbols

from .test_methods import ODD, mixed

DOCS = "doc_id long, text string, output string, form string, ids string, _fim_id string, part string"
BYTE, PIECE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    return [None, *ODD, *mixed(60, 5), "a▁b", "x \n y\n\n z", "one two\nthree\n", "\n\n", "caf\xe9 au\xa0lait　x", "word " * 40_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if n % 11 == 5 else n // 2 if n % 7 == 0 else n, t) for n, t in enumerate(texts)]
    rows += [rows[20]] * 5
    return spark.createDataFrame([(i, t, "o", "f", "i", "x", "p") for i, t in rows], DOCS)


def test_words_lose_no_byte(texts):
    words = SpacedWords(pa.array(texts, pa.string()))
    found = words.distinct.take(pa.array(words.which)).to_pylist()
    for text, a, b in zip(texts, words.at[:-1], words.at[1:]):
        assert "".join(found[a:b]) == (" " + text if text else "")
        assert all(w[0] in " \n" for w in found[a:b])


# ---------------------------------------------------------------- token files


def key(i):
    return (i is not None, i or 0)


def test_token_files_equal_the_library(docs, spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    catalogue = token_files.write_token_files(docs, str(tmp_path / "files"), length=16, batch_rows=4, file_bytes=20_000)
    found = sorted(token_files.read_token_files(catalogue).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in docs.collect()), key=key)
    want = defaultdict(list)
    for row in docs.collect():
        want[row.doc_id].append([*library.encode(row.text or "", add_special_tokens=False).ids, 1])
    at = 0
    for row in found:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert row.start == at and row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(row.ids)
        want[row.doc_id].remove(ids)
        at += len(ids)


def test_sequences_are_views_of_equal_length(docs, tmp_path):
    files = token_files.write_token_files(docs, str(tmp_path / "files"), length=16, batch_rows=4).collect()
    assert sum(f.n_documents for f in files) == docs.count()
    for file in files:
        held = token_files.SequenceFile(f"{file.file}.arrow")
        assert len(held) == -(-file.n_tokens // 16)
        whole = np.concatenate(list(held.tokens(0, file.n_tokens)))
        for n in (0, len(held) // 2, len(held) - 1):
            ids, mask = held.sequence(n)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            assert sum(mask.to_pylist()) == min(16, file.n_tokens - 16 * n)
            assert ids[: sum(mask.to_pylist())].tolist() == whole[16 * n : 16 * n + 16].tolist()
        with pytest.raises(IndexError):
            held.sequence(len(held))


def test_token_files_of_nothing(spark, tmp_path):
    catalogue = token_files.write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "files"))
    assert token_files.read_token_files(catalogue).count() == 0


def test_starts_over_groups_of_files(spark):
    files = spark.createDataFrame([(n, f"f{n}", 1, n + 1) for n in range(10)], token_files.CATALOGUE)
    found = {r.part: r.ids_before for r in token_files.with_starts(files, step=3).collect()}
    assert found == {n: sum(range(1, n + 1)) for n in range(10)}


# ---------------------------------------------------------------- fill in the middle


def test_rearranged_texts_equal_the_plain_rule(docs):
    import re

    found = fim.restore(fim.fill_in_middle(docs)).collect()
    assert len(found) == docs.count()
    for row in found:
        text = row.text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = [int(hashlib.sha256(f"7:{'' if row.doc_id is None else row.doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
        form = "plain" if not text else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (row.n_lines, row.form, bytes(row.output).decode(), bytes(row.restored).decode()) == (len(lines), form, want, text)
        assert (row.prefix_chars, row.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_texts_with_sentinels_stay_plain_and_others_come_back(monkeypatch):
    monkeypatch.setattr(fim, "SWAP_BYTES", 3)
    r = random.Random(2)
    for n in range(3000):
        text = "".join(r.choice(["<", "P", "S", "M", ">", "\n", "é", "<P", "S>"]) for _ in range(r.randrange(30))).encode()
        _, form, _, _, output = fim.transform(n, text, 7, 80, 50)
        assert fim.put_back(output, form) == text
        if any(s in text for s in (b"<P>", b"<S>", b"<M>")):
            assert form == "plain"


def test_fill_in_middle_of_nothing_keeps_columns(spark, docs):
    found = fim.fill_in_middle(spark.createDataFrame([], DOCS))
    assert found.count() == 0 and found.columns == ["doc_id", "text", "ids", "_fim_id", "part", *[n for n, _ in fim.NEW]]
    assert {r._fim_id for r in fim.fill_in_middle(docs).collect()} == {"x"}


# ---------------------------------------------------------------- alignment


def plain_tokens(text):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    of = {sign: n for n, sign in enumerate(byte_symbols())}
    left = [(n, bytes(of[c] for c in a.id_to_token(n))) for n in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(n, bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode()) for n in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else None


def spans(tokens):
    ends = np.cumsum([len(x) for _, x in tokens])
    return [(n, e - len(x), e) for (n, x), e in zip(tokens, ends.tolist())]


def test_alignment_equals_the_plain_rule(spark, texts, tmp_path):
    short = [t if t is None else t[:400] for t in texts] + ["the <|endoftext|> end", "the the  the", "the the  the"]
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    counts, plain = Counter(), {}
    for n, text in enumerate(short):
        tokens = plain_tokens(text) if text else None
        if tokens:
            a, b = map(spans, tokens)
            links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
            cut = sorted({e for *_, e in a} & {e for *_, e in b})
            groups = [
                ",".join(str(i) for i, _, e in a if lo < e <= hi) + "|" + ",".join(str(j) for j, _, e in b if lo < e <= hi)
                for lo, hi in zip([0, *cut], cut)
            ]
            counts.update(links)
            plain[n] = len(a), len(b), links, groups
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    found = token_alignment.align(docs.repartition(5), folder=str(tmp_path / "index"), bucket_pairs=100, fan_in=2).collect()
    assert len(found) == len(short) and plain.keys() != {r.doc_id for r in found}
    for row in found:
        if row.doc_id not in plain:
            assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, links, groups = plain[row.doc_id]
        sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        assert tuple(row)[1:] == (n_a, n_b, len(groups), len(links), *sums, ";".join(groups))


def test_alignment_of_odd_tables(spark, docs, tmp_path):
    assert token_alignment.align(spark.createDataFrame([], DOCS), folder=str(tmp_path / "a")).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in token_alignment.align(none, folder=str(tmp_path / "b")).collect()} == {(0, 0, 0, 0, 0, 0, "")}
    found = token_alignment.align(docs, folder=str(tmp_path / "c")).collect()
    assert len(found) == docs.count() and all(r.n_links + r.n_groups == r.n_a + r.n_b for r in found)


def test_perfect_hash_numbers_every_key_once():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.unique(r.integers(0, 1 << 60, n))
        hashed = token_alignment.PerfectHash.build(keys)
        assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))


def test_unknown_pairs_are_an_error(tmp_path):
    keys = np.arange(50, dtype=np.int64)
    hashed = token_alignment.PerfectHash.build(keys)
    ordered = np.empty_like(keys)
    ordered[hashed.numbers(keys)] = keys
    token_alignment.write_bucket(f"{tmp_path}/counts-0.arrow", sizes=hashed.sizes, bits=hashed.bits, pairs=ordered, counts=ordered * 2)
    lookup = token_alignment.Buckets(str(tmp_path), 1, counted=True)
    assert lookup.counts(np.array([3, 3, 49])).tolist() == [6, 6, 98]
    with pytest.raises(LookupError):
        lookup.counts(np.array([3, 51]))
