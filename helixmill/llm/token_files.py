"""Token ids as Arrow files of equal-length sequences, read back without copies.

Rows are range-partitioned and sorted by id. Each task encodes its texts, appends the closing id
to each and writes the running ids into one file in the Arrow file format: record batches of
``batch_rows`` rows with the columns ``ids`` (fixed-size list of ``length`` unsigned integers, 16
bits if the vocabulary allows, else 32) and ``mask`` (fixed-size list of bits: 1 a token, 0
padding, which only ends a file). A second small file holds doc_id, start and n_tokens of its documents. All batches but the last have
the same shape, so sequence i or token t is found by arithmetic, and ``SequenceFile`` hands out
views of the memory-mapped file. A table of the files, in order, with the number of ids before each
is the catalogue; it lists only files of tasks that finished, so retried or lost tasks leave
nothing a reader sees.

White space is dropped before merging, so no token and no special string reaches across a blank:
each different word of a block of 8 MB is encoded once, and its ids are gathered for all its places.

Scale: one shuffle of the texts, as a global order needs; the number of files follows the bytes of
text, 64 MB each. Rows that repeat an id are ordered by a hash of their text and spread by the
partition they come from, so a repeated id or row is no hot key. A task holds a block of texts with
its ids, one batch of sequences and a bounded cache of pre-tokens. The catalogue has a row per file (some 10^6 at 100 TB), summed
in two levels.

Cases: null or empty text is the closing id alone; null ids come first and stay null; repeated rows
are written as often as they come; an empty table gives an empty catalogue; bytes that are no UTF-8
count as U+FFFD; other columns are ignored; a very long text is a block of its own and runs through as many
sequences as it fills.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.spaced import SpacedWords, gather
from helixmill.llm.text import Characters, blocks, flat_utf8
from helixmill.llm.token_counts import byte_symbols, normalise
from helixmill.llm.warc import storage
from helixmill.session import materialize, shared_folder

FILE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 23
KNOWN_TOKENS = 400_000
WORD_END = b"\xff"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
CATALOGUE = "part int, file string, n_documents long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def sequence_schema(length: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class WordEncoder:
    """Ids of all texts of a block; each different word, and of these each different pre-token, is encoded once.

    Pre-tokens are merged by a byte-pair encoder to which the word end is one more byte (0xFF, which
    no UTF-8 holds): its merges with a last byte come before all others, as in the vocabulary.
    Words with a special string are left to the tokenizer library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix, byte_of = spec["model"]["end_of_word_suffix"], {sign: n for n, sign in enumerate(byte_symbols())}
        ranks = {}
        for entry, n in spec["model"]["vocab"].items():
            final = entry.endswith(suffix) and len(entry) > len(suffix)
            body = entry.removesuffix(suffix) if final else entry
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + (WORD_END if final else b"")] = n
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        for name in self.special:
            ranks.pop(name.encode(), None)
        self.encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32

    def _tokens(self, different: list[str]) -> list[bytes]:
        new = [w for w in different if w not in self.known]
        if len(self.known) + len(new) > KNOWN_TOKENS:
            self.known, new = {}, different
        found = [self.encode(word.encode() + WORD_END) for word in new]
        sizes, at, width = [len(f) for f in found], 0, np.dtype(self.kind).itemsize
        flat = np.fromiter(chain.from_iterable(found), self.kind, sum(sizes)).tobytes()
        for word, size in zip(new, sizes):
            self.known[word] = flat[at : at + size * width]
            at += size * width
        return [self.known[w] for w in different]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        wide = pc.invert(pc.string_is_ascii(words))
        own = pa.array([normalise(w) for w in words.filter(wide).to_pylist()], pa.large_string())
        chars = Characters(*flat_utf8(pc.replace_with_mask(pc.ascii_lower(words), wide, own)))
        begins, ends = chars.spans(attach_space=False)
        different, which = chars.distinct(begins, ends) if len(begins) else ([], np.zeros(0, np.int64))
        known = self._tokens(different)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        ids = gather(np.frombuffer(b"".join(known), self.kind), sizes, which)
        running = np.concatenate(([0], np.cumsum(sizes[which])))
        return ids, np.diff(running[chars.per_text(begins)])

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        words = SpacedWords(texts)
        if not len(words.distinct):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        ids, sizes = self._words(words.distinct)
        marked = np.flatnonzero(pc.match_substring(words.distinct, "<|").to_numpy(zero_copy_only=False))
        odd = {n: w for n in marked.tolist() if any(s in (w := words.distinct[n].as_py()) for s in self.special)}
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for n, word in odd.items():
                parts[n] = np.array(self.library.encode(word, add_special_tokens=False).ids, self.kind)
                sizes[n] = len(parts[n])
            ids = np.concatenate(parts)
        return gather(ids, sizes, words.which), words.sums(sizes)


class SequenceWriter:
    """Ids in, record batches of full sequences out."""

    def __init__(self, out, length: int, batch_rows: int, kind: type):
        self.length, self.schema = length, sequence_schema(length, kind)
        self.writer = pa.ipc.new_file(out, self.schema)
        self.buffer, self.used, self.written = np.zeros(length * batch_rows, kind), 0, 0

    def append(self, ids: np.ndarray) -> None:
        while len(ids):
            take = min(len(ids), len(self.buffer) - self.used)
            self.buffer[self.used : self.used + take] = ids[:take]
            self.used, ids = self.used + take, ids[take:]
            if self.used == len(self.buffer):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        if rows:
            ids = self.buffer[: rows * self.length]
            ids[self.used :] = 0
            mask = np.arange(rows * self.length) < self.used
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.written, self.used = self.written + self.used, 0

    def close(self) -> int:
        self._flush()
        self.writer.close()
        return self.written


class SequenceFile:
    """Random access to one file of sequences; arrays are views of the mapped file."""

    def __init__(self, path: str):
        system, local = storage(path)
        mapped = system.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(local) if mapped else system.open_input_file(local))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.batch_rows = self.reader.get_batch(0).num_rows if self.batches else 1
        self._at, self._batch = -1, None

    def __len__(self) -> int:
        return (self.batches - 1) * self.batch_rows + self.reader.get_batch(self.batches - 1).num_rows if self.batches else 0

    def _column(self, n: int, name: str) -> pa.Array:
        if n != self._at:
            self._at, self._batch = n, self.reader.get_batch(n)
        return self._batch.column(name).values

    def sequence(self, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (bits) of the n-th sequence, both views of the file."""
        if not 0 <= n < len(self):
            raise IndexError(n)
        batch, row = divmod(n, self.batch_rows)
        ids, mask = (self._column(batch, name).slice(row * self.length, self.length) for name in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as one view per record batch they lie in."""
        size = self.length * self.batch_rows
        while n > 0:
            batch, at = divmod(start, size)
            view = self._column(batch, "ids").slice(at, n).to_numpy(zero_copy_only=True)
            yield view
            start, n = start + len(view), n - len(view)


def _number_of_files(docs: DataFrame, file_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(1, -(-size // file_bytes), docs.sparkSession.sparkContext.defaultParallelism)


def write_token_files(
    docs: DataFrame,
    folder: str,
    length: int = 1024,
    closing: int = 1,
    tokenizer: str | None = None,
    batch_rows: int = 256,
    file_bytes: int = FILE_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write all texts, in the order of their ids, and return the catalogue of the files."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_column).cast("string")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    placed = chosen.repartitionByRange(_number_of_files(chosen, file_bytes), *order).sortWithinPartitions(*order[:2])

    def write(batches):
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, root = storage(folder)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        encoder, start, documents = WordEncoder(path), 0, 0
        with system.open_output_stream(f"{root}/{name}.arrow") as out, system.open_output_stream(f"{root}/{name}.docs.arrow") as list_out:
            sequences, index = SequenceWriter(out, length, batch_rows, encoder.kind), pa.ipc.new_file(list_out, INDEX)
            for block in blocks((b for group in ([first], batches) for b in group), BLOCK_BYTES):
                ids, sizes = encoder.block(block.column("text"))
                sequences.append(np.insert(ids, np.cumsum(sizes), closing))
                sizes = sizes + 1
                ends = start + np.cumsum(sizes)
                index.write_batch(pa.record_batch([block.column("doc_id"), pa.array(ends - sizes), pa.array(sizes)], schema=INDEX))
                start, documents = int(ends[-1]), documents + block.num_rows
            index.close()
            sequences.close()
        result = [[TaskContext.get().partitionId()], [f"{folder.rstrip('/')}/{name}"], [documents], [start]]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(result, types)], ["part", "file", "n_documents", "n_tokens"])

    return with_starts(materialize(placed.mapInArrow(write, CATALOGUE)))


def with_starts(files: DataFrame, step: int = 1024) -> DataFrame:
    """The files with ``ids_before``: running sums inside groups of ``step`` files and over the groups."""
    grouped = files.withColumn("_group", F.floor(F.col("part") / step))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("n_tokens").alias("_n")).select("_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summed = grouped.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return summed.join(groups, "_group").select(*files.columns, (F.col("_base") + F.col("_inside")).alias("ids_before"))


def read_token_files(catalogue: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document from its file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, its ids as little-endian bytes; sequences are mapped, not loaded."""
    files = materialize(catalogue)

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("ids_before").to_pylist()):
                sequences = SequenceFile(f"{name}.arrow")
                system, local = storage(f"{name}.docs.arrow")
                with system.open_input_file(local) as source:
                    index = pa.ipc.open_file(source)
                    for n in range(index.num_record_batches):
                        for part in _portions(index.get_batch(n)):
                            yield _documents(part, sequences, before, with_ids)

    spread = files.select("part", "file", "ids_before").repartition(max(1, files.count()), "part", "file")
    found = spread.mapInArrow(read, DOCUMENTS)
    return found if with_ids else found.drop("ids")


def _portions(index: pa.RecordBatch, tokens: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of an index with a bounded number of tokens, or one document."""
    ends, at = np.cumsum(index.column("n_tokens").to_numpy()), 0
    while at < index.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, side="right")))
        yield index.slice(at, to - at)
        at = to


def _documents(index: pa.RecordBatch, sequences: SequenceFile, before: int, with_ids: bool) -> pa.RecordBatch:
    checksums, ids = [], []
    starts = index.column("start").to_numpy()
    for start, n in zip(starts.tolist(), index.column("n_tokens").to_pylist()):
        checksum, parts = 0, []
        for view in sequences.tokens(start, n):
            wide = view.astype("<u4", copy=False)
            checksum = zlib.crc32(wide, checksum)
            if with_ids:
                parts.append(wide.tobytes())
        checksums.append(checksum)
        ids.append(b"".join(parts) if with_ids else None)
    columns = [index.column("doc_id"), pa.array(starts + before), index.column("n_tokens"), pa.array(checksums, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Contract query: all documents written as sequences of 1024 ids of the 49k word vocabulary and read back."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), folder), with_ids=False)
