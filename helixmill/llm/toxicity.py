"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words. The machine adds a weight for each term and a product
of factor vectors for each pair of terms, so that two terms together can count for more (or less)
than each alone. It is fitted on a bounded sample: the ``max_rows`` labelled documents with the
smallest seeded hashes of their ids, each different text once, so that groups of copies do not
vote many times. Spark counts terms over the sample and chooses those that tell: alone, by a test
of independence, or together with another term, whatever each tells alone. For the second, the
sample's term sets are written to the shared folder, where each Python worker reads them once, and
each task takes a slice of the terms and counts all their pairs; a pair tells if its share of toxic
texts lies further from the shares of both its terms than chance would take any of all the pairs. The machine is fitted on the driver on the sample reduced
to those terms. Scoring is one narrow pass over all texts with the broadcast machine, whose size
is bounded by ``n_terms`` of each kind. Only the ids of the sample, bounded too, are broadcast, so no
text is shuffled; the driver holds the sample's term counts and, to fit, its sets of telling terms.
Counting pairs is quadratic in the different terms of a sampled text, and does not grow with the table.

Cases: null or empty texts get the score of a document without terms; null labels and null ids are
not learnt; a document labelled twice counts as toxic if one label says so; with nothing to learn
from, or no term that tells, every score is 0; null ids stay null; repeated rows give repeated results; ties between terms
go to the smaller hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helixmill.llm.text import blocks, flat_utf8
from helixmill.llm.warc import storage
from helixmill.llm.words import NOT_ALPHANUMERIC, word_hashes
from helixmill.session import materialize

#: expected number of pairs that chance alone takes for telling ones
FALSE_PAIRS = 0.01
PAIR_CELLS = 1 << 20
SCHEMA = "doc_id long, score double"


def term_sets(block: pa.RecordBatch, wanted: "TermFilter | None" = None) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of each text of the block: row numbers (ascending) and terms."""
    hashes, at = word_hashes(*flat_utf8(block.column("text")), separators=NOT_ALPHANUMERIC)
    rows = np.repeat(np.arange(block.num_rows), np.diff(at))
    terms = hashes.view(np.int64)
    if wanted is not None:
        keep = np.flatnonzero(wanted.maybe[hashes >> np.uint64(48)])
        rows, terms = rows[keep], wanted.index(terms[keep])
        rows, terms = rows[terms >= 0], terms[terms >= 0]
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[fresh], terms[fresh]


class TermFilter:
    """Chosen terms, with a first look-up by 16 bits that most words fail."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.terms.view(np.uint64) >> np.uint64(48)] = True

    def index(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


class FactorizationMachine:
    """Logistic factorization machine over sets of term numbers, fitted with AdaGrad."""

    def __init__(self, n_terms: int, factors: int = 4, decay: float = 1e-5, rate: float = 0.3, seed: int = 1):
        random = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(n_terms)
        self.factors = random.normal(0, 0.02, (n_terms, factors))
        self.decay, self.rate = decay, rate

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n documents, given as ascending row numbers with their terms; and the sums of their factors."""
        linear = np.bincount(rows, self.weights[terms], n)
        vectors = self.factors[terms]
        sums = np.stack([np.bincount(rows, vectors[:, f], n) for f in range(vectors.shape[1])], axis=1)
        squares = np.bincount(rows, (vectors**2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows, terms, n)[0], -40, 40)))

    def fit(self, sets: list[np.ndarray], labels: np.ndarray, epochs: int = 20, batch: int = 256, seed: int = 2) -> None:
        random, n_terms = np.random.default_rng(seed), len(self.weights)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        seen_bias, seen_w, seen_v = 1.0, np.full(n_terms, 1e-2), np.full(self.factors.shape, 1e-1)
        for _ in range(epochs):
            order = random.permutation(len(sets))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                rows = np.repeat(np.arange(len(part)), [len(sets[n]) for n in part])
                terms = np.concatenate([sets[n] for n in part]) if len(part) else np.zeros(0, np.int64)
                margin, sums = self.margins(rows, terms, len(part))
                error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[part]) / np.sqrt(len(part))
                met = np.unique(terms)
                gradient = np.bincount(terms, error[rows], n_terms)[met] + self.decay * self.weights[met]
                seen_w[met] += gradient**2
                self.weights[met] -= self.rate * gradient / np.sqrt(seen_w[met])
                pull = error[rows][:, None] * (sums[rows] - self.factors[terms])
                for f in range(self.factors.shape[1]):
                    gradient = np.bincount(terms, pull[:, f], n_terms)[met] + self.decay * self.factors[met, f]
                    seen_v[met, f] += gradient**2
                    self.factors[met, f] -= 0.5 * self.rate * gradient / np.sqrt(seen_v[met, f])
                step = float(error.sum())
                seen_bias += step**2
                self.bias -= self.rate * step / np.sqrt(seen_bias)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """doc_id, text and toxic (0/1) of the sampled documents, each different text once."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = docs.where("doc_id is not null and text is not null").select("doc_id").distinct()
    sample = marks.join(known, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = materialize(rows)
    firsts = rows.groupBy(F.xxhash64("text"), F.sha1("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return rows.join(F.broadcast(firsts), "doc_id", "left_semi")


def term_counts(rows: DataFrame) -> DataFrame:
    """term, in how many documents and in how many toxic ones, over all rows."""

    def run(batches):
        for block in blocks(batches):
            toxic = block.column("toxic").to_numpy(zero_copy_only=False)
            owners, terms = term_sets(block)
            different, which = np.unique(terms, return_inverse=True)
            n = np.bincount(which, minlength=len(different))
            bad = np.bincount(which, toxic[owners], len(different)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(n), pa.array(bad)], ["term", "n", "bad"])

    parts = rows.mapInArrow(run, "term long, n long, bad long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def set_rows(rows: DataFrame, chosen: TermFilter) -> DataFrame:
    """toxic and the numbers of the chosen terms (32-bit integers) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for block in blocks(batches):
            owners, numbers = term_sets(block, shared.value)
            at = np.searchsorted(owners, np.arange(1, block.num_rows))
            sets = [part.astype(np.int32).tobytes() for part in np.split(numbers, at)]
            yield pa.RecordBatch.from_arrays([block.column("toxic"), pa.array(sets, pa.binary())], ["toxic", "terms"])

    return rows.mapInArrow(run, "toxic int, terms binary")


def reduced(rows: DataFrame, chosen: TermFilter) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of chosen term numbers and the labels of all rows, in an order that their sets give."""
    found = sorted((bytes(r["terms"]), r["toxic"]) for r in set_rows(rows, chosen).collect())
    return [np.frombuffer(terms, np.int32) for terms, _ in found], np.array([toxic for _, toxic in found], float)


@lru_cache(1)
def held_sets(files: tuple[str, ...], n_terms: int) -> tuple:
    """Written sets as arrays, once per Python worker: all terms end to end, where each set begins, its
    size, whether it is toxic, and for each term the sets that hold it and where they begin."""
    tables = []
    for name in files:
        system, path = storage(name)
        tables.append(pq.read_table(path, filesystem=system, columns=["toxic", "terms"]))
    table = pa.concat_tables(tables)
    size = pc.binary_length(table.column("terms")).to_numpy().astype(np.int64) // 4
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_buffer(), np.int32) for x in table.column("terms"))])
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    places = np.append(0, np.cumsum(np.bincount(flat, minlength=n_terms)))
    return flat, np.cumsum(size) - size, size, table.column("toxic").to_numpy() > 0, holders, places


def surprise(n: np.ndarray, bad: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Minus the logarithm of a bound on the chance to see ``bad`` of n or further off, each bad by ``share``."""
    seen, share = bad / n, np.clip(share, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(seen > 0, seen * np.log(seen / share), 0)
        return n * (up + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - share)), 0))


def telling_in_pairs(rows: DataFrame, terms: np.ndarray, n: np.ndarray, bad: np.ndarray, share: float, n_terms: int) -> np.ndarray:
    """Of ``terms`` (ascending, with their counts) those in pairs that tell more than both terms do alone, best first."""
    least = np.log(max(1.0, len(terms) * (len(terms) - 1) / 2) / FALSE_PAIRS)
    able = n * -np.log(min(share, 1 - share)) >= least  # rarer terms reach that in no pair, whatever the labels
    terms, n, bad = terms[able], n[able], bad[able]
    if len(terms) < 2:
        return terms[:0]
    files = tuple(sorted(materialize(set_rows(rows, TermFilter(terms))).inputFiles()))
    alone, spark = bad / n, rows.sparkSession

    def run(batches):
        flat, heads, size, toxic, holders, places = held_sets(files, len(alone))
        best = np.zeros(len(alone))

        def partners(docs):
            count, at = np.zeros(len(alone), np.int64), 0
            ends = np.cumsum(size[docs])
            while at < len(docs):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + PAIR_CELLS, side="right")))
                take = np.repeat(heads[docs[at:to]] - (ends[at:to] - size[docs[at:to]] - base), size[docs[at:to]])
                count += np.bincount(flat[take + np.arange(len(take))], minlength=len(alone))
                at = to
            return count

        for batch in batches:
            for one in batch.column("id").to_pylist():
                docs = holders[places[one] : places[one + 1]]
                together = partners(docs)
                other = np.flatnonzero(together[one + 1 :]) + one + 1
                other = other[together[other] * -np.log(min(share, 1 - share)) >= least]
                if not len(other):
                    continue
                together, both_bad = together[other], partners(docs[toxic[docs]])[other]
                low, high = np.minimum(alone[other], min(alone[one], share)), np.maximum(alone[other], max(alone[one], share))
                seen = both_bad / together
                found = np.where((seen > high) | (seen < low), surprise(together, both_bad, np.where(seen > high, high, low)), 0)
                np.maximum.at(best, other, found)
                best[one] = max(best[one], found.max())
        told = np.flatnonzero(best >= least)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(best[told])], ["id", "told"])

    parts = spark.range(0, len(terms), 1, 4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "id long, told double")
    best = parts.groupBy("id").agg(F.max("told").alias("told")).orderBy(F.desc("told"), "id").limit(n_terms)
    return terms[[r["id"] for r in best.collect()]]


def learn(
    docs: DataFrame, labels: DataFrame, n_terms: int = 2048, max_rows: int = 40_000, min_docs: int = 5, seed: int = 3
) -> tuple[TermFilter, FactorizationMachine] | None:
    """The terms that tell, alone or in pairs, and the machine fitted on them."""
    rows = labelled(docs, labels, max_rows, seed)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    if not n:
        return None
    share = (bad + 1) / (n + 2)
    counted = term_counts(rows).where(F.col("n") >= min_docs).toArrow()
    each = np.stack([counted.column(c).to_numpy() for c in ("term", "n", "bad")], axis=1)
    each = each[np.argsort(each[:, 0])]
    deviation = np.abs(each[:, 2] - each[:, 1] * share) / np.sqrt(each[:, 1] * share * (1 - share))
    alone = np.argsort(-deviation, kind="stable")[:n_terms]
    alone = each[alone[deviation[alone] >= 4], 0]
    terms = np.union1d(alone, telling_in_pairs(rows, *each.T, share, n_terms))
    if not len(terms):
        return None
    chosen = TermFilter(terms)
    machine = FactorizationMachine(len(terms))
    machine.fit(*reduced(rows, chosen))
    return chosen, machine


def score(docs: DataFrame, model: tuple[TermFilter, FactorizationMachine] | None) -> DataFrame:
    """doc_id and score of every row of ``docs(doc_id, text)``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches):
            values = np.zeros(block.num_rows)
            if shared.value:
                chosen, machine = shared.value
                values = machine.scores(*term_sets(block, chosen), block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def with_score(docs: DataFrame, model: tuple[TermFilter, FactorizationMachine] | None, name: str = "_toxicity") -> DataFrame:
    """The table ``docs`` with the score as one more, last column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for block in blocks(batches):
            values = np.zeros(block.num_rows)
            if shared.value:
                chosen, machine = shared.value
                values = machine.scores(*term_sets(block, chosen), block.num_rows)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def training_rows(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 != 0


def op9_toxicity(spark, sf):
    """Contract query: learn where crc32(doc_id) mod 5 is not 0, score every document."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = score(docs, learn(docs.where(training_rows()), labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
