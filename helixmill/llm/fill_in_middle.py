"""Fill-in-the-middle rows by rotating blocks inside one byte buffer, and their exact inverse.

A text is scanned once for its line ends. Two cuts, drawn from a hash of seed and id, split its
lines into prefix, middle and suffix. The three sentinels go into a bytearray before their
segments, in the order prefix, middle, suffix. Each form is then one exchange of two neighbouring
blocks, done by reversing both blocks and then the whole (three reversals):

* psm exchanges middle and suffix: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm exchanges prefix+middle with suffix: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

``restore`` finds the sentinels, does the opposite exchange and takes the sentinels out. A text
that holds a sentinel itself stays plain, so the sentinels of an output are the only ones in it:
no sentinel can arise across a joint, since each begins with ``<`` and has it nowhere else.

Scale: narrow passes, no shuffle. Reversals swap pieces of 64 kB, so a very long text needs its
buffer and nothing more; Arrow batches are worked off row by row.

Cases: null or empty text gives a plain, empty output with no lines; bytes that are not UTF-8 are
moved like all others; a null id hashes like an empty one; equal rows get equal cuts; an empty
table gives no rows; columns of the table are kept unless they bear the name of a new one, which
then takes their place (``restored`` likewise).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm.text import blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SWAP_BYTES = 1 << 16
NEW = [
    ("n_lines", T.LongType()),
    ("form", T.StringType()),
    ("prefix_chars", T.LongType()),
    ("middle_chars", T.LongType()),
    ("output", T.BinaryType()),
]


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Turn view[start:end] round in place, 64 kB from each side at a time."""
    while end - start > 1:
        size = min(SWAP_BYTES, (end - start) // 2)
        left = view[start : start + size].copy()
        view[start : start + size] = view[end - size : end][::-1]
        view[end - size : end] = left[::-1]
        start, end = start + size, end - size


def exchange(buffer: bytearray, start: int, between: int, end: int) -> None:
    """buffer[start:between] and buffer[between:end] change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, between)
    reverse(view, between, end)
    reverse(view, start, end)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers that depend on seed and id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], ">u4").tolist()


def line_ends(text: bytes) -> np.ndarray:
    """The end of every line; a last line may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and text[-1] != 10 else ends


def characters(text: bytes, start: int, end: int) -> int:
    """Code points of a part: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8, end - start, start) & 0xC0) != 0x80)) if end > start else 0


def rearrange(text: bytes, cuts: tuple[int, int], spm: bool) -> bytes:
    """The text with sentinels, its segments moved; ``cuts`` are byte positions."""
    first, second = cuts
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    exchange(buffer, 0 if spm else middle, suffix, len(buffer))
    return bytes(buffer)


def put_back(output: bytes, form: str) -> bytes:
    """The exact text an output was made from."""
    if form == "plain":
        return output
    buffer, length = bytearray(output), len(output)
    if form == "spm":
        exchange(buffer, 0, buffer.index(PREFIX), length)
    else:
        exchange(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), length)
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def transform(doc_id: int | None, text: bytes, seed: int, rate: int, spm_rate: int) -> tuple:
    """n_lines, form, prefix_chars, middle_chars and output of one text."""
    one, two, chance, kind = draws(seed, doc_id)
    ends = line_ends(text)
    n = len(ends)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or chance % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
    spm = kind % 100 < spm_rate
    output = rearrange(text, (first, second), spm)
    return n, "spm" if spm else "psm", characters(text, 0, first), characters(text, first, second), output


def _appending(rows: DataFrame, inputs: dict, new: list, run) -> DataFrame:
    """The rows with the columns ``new`` that ``run`` makes from the columns ``inputs``; the last input is the bulky one."""
    taken = {c.lower() for c in rows.columns}
    given = {}
    for name in inputs:
        given[name] = f"_{name}"
        while given[name] in taken:
            given[name] = "_" + given[name]
    made = [name for name, _ in new]
    kept = [c for c in rows.columns if c.lower() not in made]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind in new])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def work(batches):
        for batch in batches:
            bulk, at = batch.column(given[name]), 0
            for part in blocks([pa.RecordBatch.from_arrays([bulk], ["text"])]):
                here, at = batch.slice(at, part.num_rows), at + part.num_rows
                found = [run(*row) for row in zip(*(here.column(g).to_pylist() for g in given.values()))]
                columns = [pa.array(v, arrow[kind]) for v, (_, kind) in zip(zip(*found), new)]
                yield pa.RecordBatch.from_arrays([here.column(c) for c in kept] + columns, kept + made)

    return rows.select(*kept, *[column.alias(given[n]) for n, column in inputs.items()]).mapInArrow(work, schema)


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows with n_lines, form (psm, spm or plain), prefix_chars, middle_chars and output (bytes of UTF-8)."""
    text = F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit("").cast("binary"))
    inputs = {"fim_id": F.col(id_column).cast("long"), "fim_text": text}
    return _appending(docs, inputs, NEW, lambda i, t: transform(i, t, seed, rate, spm_rate))


def restore(rows: DataFrame, form_column: str = "form", output_column: str = "output") -> DataFrame:
    """The rows with ``restored``, the exact bytes of the text that each output was made from."""
    inputs = {"fim_form": F.col(form_column), "fim_output": F.col(output_column)}
    return _appending(rows, inputs, [("restored", T.BinaryType())], lambda f, o: (put_back(o, f),))


def op12_fill_in_middle(spark, sf):
    """Contract query: every document rearranged and restored, by seed 7, half of them spm."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = restore(fill_in_middle(docs).drop("text"))
    return rows.select(
        "doc_id",
        F.col("n_lines").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(lines[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(lines[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(lines[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
