"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

1. Each text becomes token ids and a closing id, cut into pieces of at most ``length`` ids.
   Pre-tokens are found for whole blocks with array operations, each different pre-token is
   encoded once, and the ids of a document are gathered from those.
2. The pieces (a few numbers each, no text) are written once. Documents are dealt into groups by
   a seeded hash, so that a group is a random sample of all lengths whatever the order of the
   table; the number of groups follows the number of pieces.
3. In each group pieces are placed longest first into the leftmost sequence with room. A
   tournament tree over the free room of the sequences finds it in logarithmic time.

Scale: one narrow pass over the texts and one shuffle of five numbers per piece. A group holds
about ``group_pieces`` pieces, independent of the input. Hot sources do not matter to the hash.

Cases: null or empty text is the closing id alone; null ids go to one group by their hash and stay
null; repeated rows are packed as often as they come; an empty table gives no rows; other columns
are ignored; a very long text becomes many pieces of one group.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.text import Characters, blocks, flat_utf8
from helixmill.llm.token_counts import byte_symbols
from helixmill.llm.token_counts import pieces as cut_text
from helixmill.session import materialize

KNOWN_WORDS = 800_000
ENCODE_BYTES = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def _piece_encoding(path: str):
    """The file's vocabulary for single pre-tokens, without the overhead of offsets and masks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    of = {sign: n for n, sign in enumerate(byte_symbols())}
    ranks = {bytes(of[c] for c in w): n for w, n in spec["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ..., starts[1], ... as one array."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Ids of whole texts; equal to encoding each text by itself."""

    def __init__(self, path: str):
        self.tokenizer, self.encoding, self.known = _tokenizer(path), _piece_encoding(path), {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known, new = {}, words
            encode = self.encoding.encode_ordinary
            found = [encode(w) for w in new]
            sizes, flat = [len(f) for f in found], np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            at = 0
            for word, size in zip(new, sizes):
                self.known[word] = flat[at : at + 4 * size]
                at += 4 * size
        return [self.known[w] for w in words]

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = Characters(*flat_utf8(pa.array(texts, pa.large_string())))
        begins, ends = chars.spans(attach_space=True)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        different, which = chars.distinct(begins, ends)
        known = self.words(different)
        sizes = np.fromiter((len(k) // 4 for k in known), np.int64, len(known))
        ids = np.frombuffer(b"".join(known), "<u4")
        lengths = sizes[which]
        found = ids[ragged((np.cumsum(sizes) - sizes)[which], lengths)]
        running = np.concatenate(([0], np.cumsum(lengths)))
        return found, running[chars.per_text(begins)]

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids per text; long texts are encoded in pieces cut where no pre-token is cut."""
        result: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def flush():
            found, at = self.block([t for _, t in waiting])
            for (n, _), a, b in zip(waiting, at[:-1].tolist(), at[1:].tolist()):
                result[n].append(found[a:b])
            waiting.clear()

        size = 0
        for n, text in enumerate(texts):
            text = text or ""
            if any(s in text for s in self.specials):
                result[n].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            for part in cut_text(text, ENCODE_BYTES):
                if size + len(part) > ENCODE_BYTES and waiting:
                    flush()
                    size = 0
                waiting.append((n, part))
                size += len(part)
        if waiting:
            flush()
        return [r[0] if len(r) == 1 else np.concatenate(r or [np.zeros(0, "<u4")]) for r in result]


def cut_pieces(docs: DataFrame, length: int = 1024, closing: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece of the column ``text``."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        encoder, end = Encoder(path), np.array([closing], "<u4")
        for block in blocks(batches, ENCODE_BYTES):
            rows = ([], [], [], [], [])
            for doc, ids in zip(block.column("doc_id").to_pylist(), encoder.texts(block.column("text").to_pylist())):
                ids = np.concatenate((ids, end)).astype("<u4")
                data, n = memoryview(ids.tobytes()), len(ids)
                for at in range(0, n, length):
                    to = min(at + length, n)
                    for column, value in zip(rows, (doc, at, to - at, zlib.crc32(data[at * 4 : to * 4]), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.mapInArrow(run, PIECES)


class RoomTree:
    """Free room of sequences under a tournament: every inner node holds the larger child's room."""

    def __init__(self, size: int, room: int):
        self.leaves = 1
        while self.leaves < size:
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)

    def take(self, need: int) -> tuple[int, int]:
        """The leftmost sequence with room for ``need``, and its room before; the room shrinks."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        room = tree[node]
        tree[node] = room - need
        found, node = node - self.leaves, node // 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return found, room


def first_fit_decreasing(lengths: list[int], length: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, given longest first."""
    tree = RoomTree(len(lengths), length)
    placed = [tree.take(n) for n in lengths]
    return [b for b, _ in placed], [length - room for _, room in placed]


def pack(
    docs: DataFrame,
    length: int = 1024,
    closing: int = 0,
    tokenizer: str | None = None,
    group_pieces: int = 16_384,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every piece with the sequence it lies in and its offset there."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = materialize(cut_pieces(chosen, length, closing, tokenizer))
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].tolist(), length)
        group = int(frame["_group"].iat[0])
        return frame.drop(columns="_group").assign(
            sequence_id=np.array(bins, np.int64) + (group << 32), offset=np.array(offsets, np.int64)
        )

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, PLACED)


def op5_packing(spark, sf):
    """Contract query: all documents in sequences of 1024 ids of the 50k byte vocabulary."""
    return pack(spark.read.parquet(f"{sf}/documents.parquet"))
