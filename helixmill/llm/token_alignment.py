"""How the tokens of two tokenizers overlap, with corpus-wide counts under a minimal perfect hash.

Both tokenizers are byte-preserving on most texts, so their tokens are intervals of the same bytes.
Every stretch between two neighbouring token ends (of either side) lies in exactly one token of
each: it is one link. Ends that both sides share cut the tokens into groups. Neither tokenizer
joins anything across the gap between a sign and a blank or line feed after it, so a text is a row
of words with their leading white space; each different word of a block is encoded and aligned once,
all words of the block at the same time.

1. First pass: links of a block, times the places of their words, are summed per pair of ids. A task
   hands over sums, not links.
2. The distinct pairs are dealt by a mixing hash into buckets of about ``bucket_pairs``. For each
   bucket a task builds a minimal perfect hash: levels of bit arrays in which a pair that meets no
   other takes its bit, and the rest go one level down; the rank of the bit is the pair's number.
3. The sums of the first pass become dense count vectors, one per bucket and task, indexed by that
   number, and are added up in a tree of ``fan_in`` vectors at a time. Each bucket's bits, counts and
   pairs (for verification) go to one file in the shared folder.
4. Second pass: documents are aligned anew and every link looked up: bucket, number, verification,
   count. Buckets are mapped files, of which a task keeps a bounded number open.

The highest count per id of the second tokenizer is a vector of its vocabulary's size; that size
bounds the only data sent along with the second pass, next to one path.

Scale: no text is shuffled, only per-task sums. Pairs are limited by which entries of the two
vocabularies can overlap, not by the corpus. A frequent pair is summed in the task before it
travels; a frequent bucket does not exist, as buckets hold distinct pairs. Tasks hold a block of 6 MB
of text (or one text) with its tokens and at most ``HELD_PAIRS`` sums.

Cases: null or empty text, and text that one side does not give back byte by byte (a literal
U+2581, or bytes that are no UTF-8 and count as U+FFFD on both sides: those are aligned as such)
has no tokens: zeros and an empty ``groups``. Null ids stay null; repeated rows count as often as
they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.packing import ragged
from helixmill.llm.spaced import SpacedWords
from helixmill.llm.text import blocks, flat_utf8
from helixmill.llm.token_counts import byte_symbols
from helixmill.llm.warc import storage
from helixmill.session import materialize, shared_folder

BUCKET_PAIRS = 1 << 16
OPEN_BUCKETS = 256
BLOCK_BYTES = 6 << 20
ENCODED_WORDS = 1 << 15
HELD_PAIRS = 1 << 22
GAMMA = 2.0
PAIRS = "pair long, n long"
VECTORS = "bucket int, member int, counts binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


# ---------------------------------------------------------------- words and their alignment


@lru_cache(2)
def _tokenizers(first: str, second: str):
    """Encoders of both sides, with the bytes of each entry end to end and their sizes."""
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(first)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    byte_of = {sign: n for n, sign in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in entry): n for entry, n in library.get_vocab(with_added_tokens=False).items() if entry not in special}
    a = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=second)
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for entry, n in ranks.items():
        a_bytes[n] = entry
    pieces = [(n, b.id_to_piece(n)) for n in range(b.vocab_size())]
    b_bytes = [bytes([int(piece[3:5], 16)]) if b.is_byte(n) else piece.replace("▁", " ").encode() for n, piece in pieces]
    return a, _entries(a_bytes), b, _entries(b_bytes)


def _entries(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


class Side:
    """Tokens of one side for the words of a block: ids, sizes in bytes, and the word each belongs to."""

    def __init__(self, encode, words: pa.Array, entries: tuple):
        self.entries, parts = entries, []
        for at in range(0, len(words), ENCODED_WORDS):  # lists of ids take far more room than arrays
            found = encode(words.slice(at, ENCODED_WORDS).to_pylist())
            counts = np.fromiter(map(len, found), np.int64, len(found))
            parts.append((counts, np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))))
        self.counts, self.ids = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.word = np.repeat(np.arange(len(words)), self.counts)
        self.sizes = entries[2][self.ids]

    def keep(self, usable: np.ndarray) -> None:
        kept = usable[self.word]
        self.ids, self.word, self.sizes = self.ids[kept], self.word[kept], self.sizes[kept]
        self.counts = np.where(usable, self.counts, 0)

    def data(self) -> np.ndarray:
        return self.entries[0][ragged(self.entries[1][self.ids], self.sizes)]


class AlignedWords:
    """The different words of a block of texts, aligned: all tokens lie end to end over the same bytes.

    A word that a side does not give back byte by byte is not usable, and neither is a text with it.
    The second tokenizer adds a blank by itself: words that begin with one are given to it without,
    of the others (they begin with a line feed) its added blank is taken off again.
    """

    def __init__(self, texts: pa.Array, first: str, second: str):
        a, a_entries, b, b_entries = _tokenizers(first, second)
        self.words = SpacedWords(texts)
        blank = [b.piece_to_id("▁")]

        def second_ids(words: list[str]) -> list[list[int]]:
            found = b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
            for n, word in enumerate(words):
                if word[0] != " ":
                    found[n] = found[n][1:] if found[n][:1] == blank else []
                elif len(word) == 1:
                    found[n] = blank
            return found

        encode = a._core_bpe.encode_ordinary
        self.a = Side(lambda words: [encode(w) for w in words], self.words.distinct, a_entries)
        self.b = Side(second_ids, self.words.distinct, b_entries)
        data, bounds = flat_utf8(self.words.distinct)
        self.usable = self._same_bytes(data, bounds)
        for side in (self.a, self.b):
            side.keep(self.usable)
        self._link()
        bad = self.words.sums((~self.usable).astype(np.int64)) > 0
        self.text_usable = ~bad & (np.diff(self.words.at) > 0)

    def _same_bytes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sizes = np.diff(bounds)
        same = np.ones(len(sizes), bool)
        for side in (self.a, self.b):
            same &= np.bincount(side.word, side.sizes, len(sizes)).astype(np.int64) == sizes
        for side in (self.a, self.b):
            side.keep(same)
            wrong = side.data() != data[np.repeat(same, sizes)]
            owner = np.repeat(np.flatnonzero(same), sizes[same])
            same[owner[wrong]] = False
        return same

    def _link(self) -> None:
        """One link per stretch between neighbouring ends of either side; a group per end both share."""
        n, a_ends, b_ends = len(self.usable), np.cumsum(self.a.sizes), np.cumsum(self.b.sizes)
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
        marks[a_ends] |= 1
        marks[b_ends] |= 2
        ends = np.flatnonzero(marks)
        at_a, at_b, both = (marks[ends] & 1).astype(bool), (marks[ends] & 2).astype(bool), marks[ends] == 3
        in_a, in_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
        self.pairs = self.a.ids[in_a] << 32 | self.b.ids[in_b]
        self.owner = self.a.word[in_a]
        self.n_links = np.bincount(self.owner, minlength=n)
        self.n_groups = np.bincount(self.owner[both], minlength=n)
        groups = np.cumsum(both) - both
        self.group_of_a, self.group_of_b = groups[at_a], groups[at_b]

    def texts_with(self) -> np.ndarray:
        """How often each word stands in usable texts."""
        return np.bincount(self.words.which[np.repeat(self.text_usable, np.diff(self.words.at))], minlength=len(self.usable))

    def groups(self) -> pa.Array:
        """The groups of each word as text: a1,a2|b1;a3|b2,b3."""
        total = int(self.group_of_a[-1]) + 1 if len(self.group_of_a) else 0
        a_in, b_in = np.bincount(self.group_of_a, minlength=total), np.bincount(self.group_of_b, minlength=total)
        # the tokens of a group's first side stand before those of its second
        place_a = np.arange(len(self.group_of_a)) + (np.cumsum(b_in) - b_in)[self.group_of_a]
        place_b = np.arange(len(self.group_of_b)) + np.cumsum(a_in)[self.group_of_b]
        ids, marks = np.empty(len(place_a) + len(place_b), np.int64), np.full(len(place_a) + len(place_b), 44, np.uint8)
        ids[place_a], ids[place_b] = self.a.ids, self.b.ids
        last_b = np.cumsum(a_in + b_in) - 1
        marks[last_b - b_in], marks[last_b] = ord("|"), ord(";")
        digits = np.searchsorted(10 ** np.arange(1, 19), ids, side="right") + 1
        ends = np.cumsum(digits + 1)
        text, rest, live, step = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ids.copy(), np.arange(len(ids)), 2
        text[ends - 1] = marks
        while len(live):
            text[ends[live] - step] = 48 + rest[live] % 10
            rest[live] //= 10
            live, step = live[digits[live] >= step], step + 1
        # where each word's text ends: after the mark of its last group, which is left out
        word_groups = np.cumsum(self.n_groups)
        group_ends = np.concatenate(([0], ends[last_b]))
        stops = group_ends[word_groups]
        starts = np.concatenate(([0], stops[:-1]))
        keep = np.ones(len(text), bool)
        keep[stops[stops > starts] - 1] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        offsets = np.concatenate(([0], kept[stops])).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.usable), pa.py_buffer(offsets), pa.py_buffer(text[keep].tobytes()))


def _chosen(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_column).cast("string")).alias("text"))


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different pair with the sum of its numbers."""
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    heads = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[heads], np.add.reduceat(n, heads) if len(heads) else n


def pair_sums(docs: DataFrame, first: str, second: str) -> DataFrame:
    """pair (first id in the upper 32 bits) and n, the number of its links seen by a task; pairs repeat across tasks."""

    def run(batches):
        held, waiting = [], 0
        for part in blocks(batches, BLOCK_BYTES):
            aligned = AlignedWords(part.column("text"), first, second)
            times = aligned.texts_with()[aligned.owner]
            seen = times > 0
            held.append(_added(aligned.pairs[seen], times[seen]))
            waiting += len(held[-1][0])
            if waiting > HELD_PAIRS:
                held = [_added(*map(np.concatenate, zip(*held)))]
                waiting = 0
                if len(held[0][0]) > HELD_PAIRS:
                    yield _pair_rows(*held.pop())
        if held:
            yield _pair_rows(*_added(*map(np.concatenate, zip(*held))))

    return docs.select("text").mapInArrow(run, PAIRS)


def _pair_rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])


# ---------------------------------------------------------------- minimal perfect hash of the pairs


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits per key and seed (multiply and shift, modulo 2^64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers 0 to n-1 for n keys: a cascade of bit arrays, and the count of bits before each 64."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            place = (mixed(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not built in, any number or -1."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            place = (mixed(keys[open_], level + 1) % np.uint64(size)).astype(np.int64) + self.base[level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)) == 1
            low = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.before[word[hit]] + np.bitwise_count(low)
            open_ = open_[~hit]
            if not len(open_):
                break
        return found


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(pairs, 0) % np.uint64(buckets)).astype(np.int64)


def _list(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def write_bucket(path: str, **columns: np.ndarray) -> None:
    """One row of lists, put in place at once; a repeated task writes the same content again."""
    system, local = storage(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    batch = pa.RecordBatch.from_arrays([_list(v) for v in columns.values()], list(columns))
    draft = f"{local}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)
    system.move(draft, local)


def read_bucket(path: str) -> dict[str, np.ndarray]:
    system, local = storage(path)
    source = pa.memory_map(local) if system.type_name == "local" else system.open_input_file(local)
    batch = pa.ipc.open_file(source).get_batch(0)
    return {name: batch.column(name).values.to_numpy(zero_copy_only=True) for name in batch.schema.names}


class Buckets:
    """The buckets of an index, opened when they are needed, a bounded number at a time."""

    def __init__(self, folder: str, buckets: int, counted: bool):
        self.folder, self.buckets, self.kind = folder, buckets, "counts" if counted else "hash"
        self.open = OrderedDict()

    def get(self, bucket: int) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        if bucket not in self.open:
            columns = read_bucket(f"{self.folder}/{self.kind}-{bucket}.arrow")
            self.open[bucket] = PerfectHash(columns["sizes"], columns["bits"]), columns
            if len(self.open) > OPEN_BUCKETS:
                self.open.popitem(last=False)
        self.open.move_to_end(bucket)
        return self.open[bucket]

    def parts(self, pairs: np.ndarray):
        """Bucket and positions of its pairs, for every bucket that has some."""
        bucket = bucket_of(pairs, self.buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for start, end in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            yield int(bucket[order[start]]), order[start:end]

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """The corpus-wide count of each pair; a pair that is not in the index is an error."""
        different, where = np.unique(pairs, return_inverse=True)
        found = np.zeros(len(different), np.int64)
        for bucket, places in self.parts(different):
            hashed, columns = self.get(bucket)
            numbers = hashed.numbers(different[places])
            if (numbers < 0).any() or (columns["pairs"][numbers] != different[places]).any():
                raise LookupError("a pair of the second pass is not in the index")
            found[places] = columns["counts"][numbers]
        return found[where]


class PairIndex:
    """Counts of all pairs of ids: a folder of buckets, and the highest count per second id."""

    def __init__(self, folder: str, buckets: int, best: np.ndarray):
        self.folder, self.buckets, self.best = folder, buckets, best


def build_index(sums: DataFrame, folder: str, second_size: int, bucket_pairs: int = BUCKET_PAIRS, fan_in: int = 32) -> PairIndex:
    """Write the index of ``sums`` (pair, n; written once before) to ``folder``."""
    distinct = materialize(sums.select("pair").distinct())
    buckets = max(1, -(-distinct.count() // bucket_pairs))

    @F.pandas_udf("int")
    def bucket(pairs: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(pairs.to_numpy(np.int64), buckets), dtype=np.int32)

    def hash_bucket(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pairs = np.sort(frame["pair"].to_numpy(np.int64))
        hashed, ordered = PerfectHash.build(pairs), np.empty_like(pairs)
        ordered[hashed.numbers(pairs)] = pairs
        write_bucket(f"{folder}/hash-{int(key[0])}.arrow", sizes=hashed.sizes, bits=hashed.bits, pairs=ordered)
        return pd.DataFrame({"bucket": [int(key[0])]})

    materialize(distinct.withColumn("bucket", bucket("pair")).groupBy("bucket").applyInPandas(hash_bucket, "bucket int"))

    def vectors(batches):
        index, held = Buckets(folder, buckets, counted=False), {}
        for batch in batches:
            pairs, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            for number, places in index.parts(pairs):
                hashed, columns = index.get(number)
                if number not in held:
                    held[number] = np.zeros(len(columns["pairs"]), np.int64)
                slots = hashed.numbers(pairs[places])
                if (slots < 0).any() or (columns["pairs"][slots] != pairs[places]).any():
                    raise LookupError("a pair was counted that is not hashed")
                np.add.at(held[number], slots, n[places])
                if len(held) > OPEN_BUCKETS:
                    done = next(iter(held))
                    yield _vector_row(done, held.pop(done))
        for number, counts in held.items():
            yield _vector_row(number, counts)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(counts, "<i8") for counts in frame["counts"])
        return pd.DataFrame({"bucket": [int(key[0])], "member": [int(key[1])], "counts": [total.tobytes()]})

    level = materialize(sums.mapInArrow(vectors, VECTORS))
    width = level.agg(F.max("member")).head()[0] or 0
    while width:
        up = level.withColumn("member", F.floor(F.col("member") / fan_in).cast("int"))
        level, width = materialize(up.groupBy("bucket", "member").applyInPandas(add, VECTORS)), width // fan_in

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashed = read_bucket(f"{folder}/hash-{int(key[0])}.arrow")
        counts = sum(np.frombuffer(c, "<i8") for c in frame["counts"])
        write_bucket(f"{folder}/counts-{int(key[0])}.arrow", **hashed, counts=counts)
        second = hashed["pairs"] & 0xFFFFFFFF
        best = pd.Series(counts).groupby(second).max()
        return pd.DataFrame({"second": best.index.to_numpy(), "n": best.to_numpy()})

    found = level.groupBy("bucket").applyInPandas(finish, "second long, n long").groupBy("second").agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(second_size, np.int64)
    best[found["second"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return PairIndex(folder, buckets, best)


def _vector_row(bucket: int, counts: np.ndarray) -> pa.RecordBatch:
    row = [[bucket], [TaskContext.get().partitionId()], [counts.astype("<i8").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "member", "counts"])


# ---------------------------------------------------------------- documents


def align(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    folder: str | None = None,
    bucket_pairs: int = BUCKET_PAIRS,
    fan_in: int = 32,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: tokens of both sides, groups, links, links of the highest count of their second id, the sum
    of all links' counts, and the groups themselves (``a1,a2|b1;a3|b2,b3``)."""
    first, second = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    folder = folder or f"{shared_folder(docs.sparkSession)}/pair-index-{uuid.uuid4().hex}"
    chosen = _chosen(docs, id_column, text_column)
    second_size = _tokenizers(first, second)[2].vocab_size()
    index = build_index(materialize(pair_sums(chosen, first, second)), folder, second_size, bucket_pairs, fan_in)

    def run(batches):
        lookup, best = Buckets(index.folder, index.buckets, counted=True), index.best
        for part in blocks(batches, BLOCK_BYTES):
            aligned = AlignedWords(part.column("text"), first, second)
            # words of unusable texts only may hold pairs that were never counted
            wanted = (aligned.texts_with() > 0)[aligned.owner]
            counts = np.zeros(len(aligned.pairs), np.int64)
            counts[wanted] = lookup.counts(aligned.pairs[wanted])
            highest = wanted & (counts == best[aligned.pairs & 0xFFFFFFFF])
            n = len(aligned.usable)
            per_word = [aligned.a.counts, aligned.b.counts, aligned.n_groups, aligned.n_links]
            per_word += [np.bincount(aligned.owner[highest], minlength=n), _grouped_sum(aligned.owner, counts, n)]
            sums = [pa.array(aligned.words.sums(v) * aligned.text_usable) for v in per_word]
            words, at = aligned.words, aligned.words.at
            lists = pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), aligned.groups().take(pa.array(words.which)))
            joined = pc.binary_join(lists, pa.scalar(";", pa.large_string()))
            groups = pc.if_else(pa.array(aligned.text_usable), joined, pa.scalar("", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sums, groups], [f.split()[0] for f in ALIGNED.split(", ")])
            del aligned, words, lists, joined, groups
            pa.default_memory_pool().release_unused()

    return chosen.mapInArrow(run, ALIGNED)


def _grouped_sum(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers whose owners ascend, exactly."""
    running = np.concatenate(([0], np.cumsum(values)))
    at = np.searchsorted(owner, np.arange(n + 1))
    return running[at[1:]] - running[at[:-1]]


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Contract query: all documents under the 50k byte and the 32k piece vocabulary."""
    found = align(spark.read.parquet(f"{sf}/documents.parquet"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
