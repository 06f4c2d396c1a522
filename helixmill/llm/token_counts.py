"""Token counts by rank-synchronous merging of ragged symbol arrays.

A text is normalised and cut into pre-tokens as the tokenizer file says (composed form, lower
case, white space dropped). All different pre-tokens of a block that were not met before are
held end to end in one array of symbols. One round finds the lowest-rank mergeable pair of every
sequence at once and merges all its occurrences; sequences without a pair leave with the number
of symbols they still have. No step looks at one text or one word at a time.

Scale: one narrow pass (``mapInArrow``), no shuffle; arrays are bounded by a block of 2 MB and by
the cache of known pre-tokens. One text may exceed a block and is then cut at white space.

Cases: null or empty text has 0 bytes and 0 tokens; null ids stay null; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.text import BLOCK_BYTES, Characters, blocks, flat_utf8

KNOWN_WORDS = 400_000
NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable sign that byte-level vocabularies use for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Pairs of symbols with their ranks, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        signs = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in signs], np.int64)
        self.final = np.array([vocabulary[s + suffix] for s in signs], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One symbol per byte, the last of each word in its word-end form."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        found, last = self.inner[data], np.cumsum(lengths) - 1
        found[last] = self.final[data[last]]
        return found, lengths

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each non-empty word are left when nothing can be merged."""
        result = np.ones(len(words), np.int64)
        symbols, lengths = self.symbols(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            together = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NEVER)
            rank[:-1][together] = self.pair_ranks(symbols[:-1][together], symbols[1:][together])
            heads = np.flatnonzero(np.append(True, ~together))
            sizes = np.diff(np.append(heads, len(symbols)))
            lowest = np.minimum.reduceat(rank, heads)
            done = lowest == NEVER
            result[owner[heads[done]]] = sizes[done]
            chosen = (rank == np.repeat(lowest, sizes)) & (rank != NEVER)
            # of overlapping occurrences (a a a) the first, third, ... are merged
            place = np.flatnonzero(chosen)
            fresh = np.append(True, np.diff(place) > 1) if len(place) else np.zeros(0, bool)
            run_head = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0)) if len(place) else place
            place = place[(np.arange(len(place)) - run_head) % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return result


@lru_cache(4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def normalise(text: str) -> str:
    """Composed form and lower case, sign by sign (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(text: str, limit: int) -> Iterator[str]:
    """A long text in pieces that begin at white space after a word, where no pre-token is cut."""
    at, gap = 0, re.compile(r"(?<=\w) ")
    while len(text) - at > limit:
        cut = gap.search(text, at + limit // 2)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Counter:
    def __init__(self, path: str):
        self.table, self.known = merge_table(path), {}
        self.special = re.compile("|".join(map(re.escape, self.table.specials))) if self.table.specials else None

    def words(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known = {}
                new = words
            self.known.update(zip(new, self.table.surviving([w.encode() for w in new]).tolist()))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        parts, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            cut = [text or ""]
            if text and "<|" in text and self.special:
                cut = self.special.split(text)
                counts[n] += len(cut) - 1
            for part in cut:
                for piece in pieces(part, BLOCK_BYTES):
                    parts.append(normalise(piece))
                    owner.append(n)
        at = 0
        while at < len(parts):  # a very long text fills blocks of its own
            to, size = at + 1, len(parts[at])
            while to < len(parts) and size + len(parts[to]) <= BLOCK_BYTES:
                size += len(parts[to])
                to += 1
            chars = Characters(*flat_utf8(pa.array(parts[at:to], pa.large_string())))
            begins, ends = chars.spans(attach_space=False)
            if len(begins):
                different, which = chars.distinct(begins, ends)
                running = np.concatenate(([0], np.cumsum(self.words(different)[which])))
                bounds = chars.per_text(begins)
                np.add.at(counts, owner[at:to], running[bounds[1:]] - running[bounds[:-1]])
            at = to
        return counts


def count_tokens(
    docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        counter = Counter(path)
        for block in blocks(batches):
            text = block.column("text")
            _, at = flat_utf8(text)
            tokens = counter.texts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(at)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"]
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def op4_token_counts(spark, sf):
    """Contract query: tokens of every document under the 49k word vocabulary, limit 2048."""
    counts = count_tokens(spark.read.parquet(f"{sf}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
