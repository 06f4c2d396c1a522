"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of different character n-grams (one to three signs, letters
folded to lower case, everything else to one blank) that both contain, over the root of the
product of their numbers of n-grams. A few texts per language serve as Nystroem landmarks; kernel
ridge regression, one language against the rest, is solved in the landmark space on a bounded
sample. Prediction is a batched matrix product of presence rows with the landmarks' presence
columns, folded once with the ridge weights.

The sample is the only bound: ``per_language`` labelled texts of each language, those with the
smallest seeded hashes of their ids, of which the first ``landmarks`` are landmarks. It is chosen
on ids alone: counts per language (one row each, as few as there are languages) say below which
hash about twice as many rows lie, and only those are ranked.

Cases: null text or text without a letter is ``und`` with score 0; null languages are not learnt;
with nothing to learn from every row is ``und``; null ids stay null and are never learnt; repeated
rows give repeated results; ties go to the language that sorts first; an empty table gives no rows;
other columns are ignored; whole texts are read, in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.text import LETTER, character_classes, blocks

ORDERS, BUCKETS = (1, 2, 3), 1 << 16
SCHEMA = "doc_id long, lang_pred string, score double"


@lru_cache(1)
def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for anything that is not a letter."""
    table = np.arange(0x110000, dtype=np.uint32)
    letters = np.flatnonzero(character_classes() == LETTER)
    table[:] = 32
    table[letters] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return table


def ngram_buckets(text: str | None) -> np.ndarray | None:
    """The different n-grams of a whole text as hash buckets; None if it has no letter."""
    points = _folded()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    if not (points != 32).any():
        return None
    # runs of blanks count as one
    points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    present = np.zeros(BUCKETS, bool)
    for order in ORDERS:
        if len(points) < order:
            break
        code = np.full(len(points) - order + 1, 0x9E3779B9 * order & 0xFFFFFFFF, np.uint32)
        for n in range(order):
            code = (code ^ points[n : len(points) - order + 1 + n]) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
        present[code >> np.uint32(16)] = True
    return np.flatnonzero(present)


class KernelRidge:
    """Nystroem features over landmark texts and one ridge regression per language."""

    def __init__(self, texts: list[np.ndarray], labels: list[str], landmarks: list[int], ridge: float = 1e-2):
        self.labels = sorted(set(labels))
        chosen = [texts[n] for n in landmarks]
        self.columns = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        presence = self._rows(chosen)
        scale = np.array([len(c) for c in chosen], np.float32) ** -0.5
        presence *= scale[:, None]
        values, vectors = np.linalg.eigh((presence @ presence.T).astype(np.float64))
        good = values > 1e-6 * max(values.max(initial=0), 1e-12)
        root = vectors[:, good] * values[good] ** -0.5
        kernel = np.vstack([self.kernel(texts[n : n + 256], presence) for n in range(0, len(texts), 256)])
        features = np.hstack([kernel @ root, np.ones((len(texts), 1))])
        target = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        gram = features.T @ features + ridge * np.eye(features.shape[1])
        weights = np.linalg.solve(gram, features.T @ target)
        self.weights = (presence.T @ (root @ weights[:-1])).astype(np.float32)
        self.bias = weights[-1]

    def _rows(self, texts: list[np.ndarray]) -> np.ndarray:
        place = np.full(BUCKETS, -1)
        place[self.columns] = np.arange(len(self.columns))
        rows = np.zeros((len(texts), len(self.columns)), np.float32)
        for n, grams in enumerate(texts):
            at = place[grams]
            rows[n, at[at >= 0]] = 1
        return rows

    def kernel(self, texts: list[np.ndarray], against: np.ndarray) -> np.ndarray:
        norms = np.array([len(t) for t in texts], np.float64) ** -0.5
        return (self._rows(texts) @ against.T).astype(np.float64) * norms[:, None]

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], list[float]]:
        norms = np.array([len(t) for t in texts], np.float64) ** -0.5
        margins = (self._rows(texts) @ self.weights).astype(np.float64) * norms[:, None] + self.bias
        best = margins.argmax(axis=1)
        shares = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        top = 1 / shares.sum(axis=1)
        return [self.labels[b] for b in best], np.clip(top, 0, 1).tolist()


def learn(docs: DataFrame, per_language: int = 240, landmarks: int = 40, seed: int = 11) -> KernelRidge | None:
    """A model from a bounded, seeded sample of ``docs(doc_id, text, lang)`` per language."""
    usable = docs.where("text is not null and lang is not null and doc_id is not null")
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    ids = usable.select("doc_id", "lang", key.alias("_key")).join(F.broadcast(counts), "lang")
    ids = ids.where(F.col("_key") / float(1 << 40) * F.col("_rows") < 2 * per_language + 60)
    order = Window.partitionBy("lang").orderBy("_key", "doc_id")
    first = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    chosen = F.broadcast(first.select("doc_id").distinct())  # per_language ids a language
    rows = usable.join(chosen, "doc_id", "left_semi").select(key.alias("_key"), "doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r["_key"], r["doc_id"], r["lang"]))
    texts, labels, marks, met = [], [], [], {}
    for row in rows:
        grams, n = ngram_buckets(row["text"]), met.get(row["lang"], 0)
        if grams is None or n >= per_language:
            continue
        if n < landmarks:
            marks.append(len(texts))
        met[row["lang"]] = n + 1
        texts.append(grams)
        labels.append(row["lang"])
    return KernelRidge(texts, labels, marks) if texts else None


def predict(docs: DataFrame, model: KernelRidge | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs(doc_id, text)``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # labels x n-gram buckets, bounded

    def run(batches):
        for block in blocks(batches):
            grams = [ngram_buckets(t) for t in block.column("text").to_pylist()]
            languages, scores = ["und"] * len(grams), [0.0] * len(grams)
            known = [n for n, g in enumerate(grams) if g is not None]
            for at in range(0, len(known) if shared.value else 0, 256):
                part = known[at : at + 256]
                for n, language, value in zip(part, *shared.value.predict([grams[n] for n in part])):
                    languages[n], scores[n] = language, value
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string"))


def op3_language(spark, sf):
    """Contract query: learn where crc32(doc_id) mod 4 is not 2, predict every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = learn(docs.where(crc_of_id() % 4 != 2))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
