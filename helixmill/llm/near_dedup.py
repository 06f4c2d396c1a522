"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its different five-word shingles. Its signature has ``SLOTS`` slots of 16
bits, each the low bits of one minimum hash; two signatures differ in a slot with probability one
minus the similarity of the sets. All pairs of signatures that differ in at most ``RADIUS`` slots
are found: the slots are split into ``CHUNKS`` chunks of four, and since RADIUS < 2 * CHUNKS, a
pair within the radius differs in at most one slot of some chunk. So each chunk is indexed once
for every slot that may be wrong, under the other three (the enumeration of the allowed error).
At similarity 0.75 a pair lies beyond the radius with a probability of about 4e-5, less above.

1. One narrow pass gives each document's set size, a 128-bit identity of its set and its signature.
   Documents with equal sets form a class; only one of a class goes on, so copies cost nothing.
2. Index rows (key, class) are dealt by key; keys met once are dropped. A bucket is read as a
   stream: up to ``LEADERS`` members that are not very close to each other are held, and every
   member within the radius of one is linked to the nearest. Each class keeps its ``LINKS`` best.
3. Links are confirmed on the full sets, made anew from the whole texts, by joins on both ends.
   Confirmed links give components.
4. Buckets with a pair within the radius that still hold several components are opened again,
   large ones split into blocks that meet pairwise: first every member is tried against its
   nearest of another component, then, with the components that gave, all pairs that are left.
   A pair is taken up in the first of the buckets it shares. A longer signature of ``FINE`` slots of 4 bits, made with the sets, weeds out pairs far below
   the threshold (a pair at 0.75 is lost with a probability of about 2e-5).
   So no close pair is lost, and groups of copies never become all their pairs.

Scale: what is shuffled is one short row per document, 60 index rows of 16 bytes per class,
signatures in buckets with company, and sets of documents with a link. Nothing is collected.

Cases: texts that are null or have no words have no set and are linked with nothing; null ids are
linked with nothing, have no component and count as kept; rows that repeat id and text are one
document, of which ``drop_near_copies`` leaves one row; a repeated id is no key, each row follows
its own text: classes are numbered by a hash of their set identity, and rows are found again by id
and a hash of the text; an empty table gives no rows; other columns are kept by
``drop_near_copies`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.components import components
from helixmill.llm.text import blocks, flat_utf8
from helixmill.llm.words import mix, word_hashes
from helixmill.session import materialize

WORDS = 5
CHUNKS, CHUNK_SLOTS = 15, 4
SLOTS = CHUNKS * CHUNK_SLOTS
RADIUS = 2 * CHUNKS - 1
LEADERS, CLOSE, LINKS, BLOCK_ROWS = 256, 13, 2, 2048
FINE, FINE_RADIUS = 512, 161

_RANDOM = np.random.default_rng(20240917)
PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
SHORT = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64)
SALT = _RANDOM.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
FACTOR = _RANDOM.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
FINE_SALT = _RANDOM.integers(1, 1 << 63, FINE, dtype=np.uint64)
FINE_FACTOR = _RANDOM.integers(1, 1 << 63, FINE, dtype=np.uint64) | np.uint64(1)
VARIANT = _RANDOM.integers(1, 1 << 63, SLOTS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text; empty without words."""
    words, at = word_hashes(*flat_utf8(texts))
    places = max(0, len(words) - WORDS + 1)
    every = np.zeros(places, np.uint64)
    for n in range(WORDS):
        every += words[n : n + places] * PLACE[n]
    every = mix(every)
    sets = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        n = end - start
        if n >= WORDS:
            sets.append(np.unique(every[start : end - WORDS + 1]))
        else:
            whole = (words[start:end] * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + SHORT[n]
            sets.append(mix(whole) if n else np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS 16-bit values per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    every, heads = np.concatenate(sets), np.cumsum(sizes) - sizes
    found = np.empty((len(sets), SLOTS), np.uint16)
    for slot in range(SLOTS):
        values = ((every ^ SALT[slot]) * FACTOR[slot]) >> np.uint64(32)
        found[:, slot] = np.minimum.reduceat(values, heads) & np.uint64(0xFFFF)
    return found


def fine_signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """FINE slots of 4 bits, two to a byte; None for an empty set."""
    found: list[bytes | None] = []
    for one in sets:
        if not len(one):
            found.append(None)
            continue
        slots = np.full(FINE, np.iinfo(np.uint64).max)
        for at in range(0, len(one), 1024):
            part = ((one[at : at + 1024, None] ^ FINE_SALT) * FINE_FACTOR).min(axis=0)
            slots = np.minimum(slots, part)
        bits = (mix(slots) & np.uint64(15)).astype(np.uint8)
        found.append((bits[::2] << 4 | bits[1::2]).tobytes())
    return found


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Per signature one key for every slot that may be wrong, under the other slots of its chunk."""
    wide = signature.astype(np.uint64).reshape(-1, CHUNKS, CHUNK_SLOTS)
    keys = np.empty((len(signature), SLOTS), np.uint64)
    for wrong in range(CHUNK_SLOTS):
        code = np.zeros(wide.shape[:2], np.uint64)
        for slot in range(CHUNK_SLOTS):
            if slot != wrong:
                code = code << np.uint64(16) | wide[:, :, slot]
        keys[:, wrong::CHUNK_SLOTS] = code
    return mix(keys ^ VARIANT).view(np.int64)


def as_matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint16)[at[0] // 2 : at[-1] // 2].reshape(-1, SLOTS)


def distance(matrix: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.count_nonzero(matrix != row, axis=1)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, the identity (h1, h2) of the set and the signature (null without a set)."""

    def run(batches):
        for block in blocks(batches):
            sets = shingle_sets(block.column("text"))
            full = [n for n, s in enumerate(sets) if len(s)]
            identity = np.zeros((2, len(sets)), np.uint64)
            signed: list = [None] * len(sets)
            if full:
                rows = signatures([sets[n] for n in full])
                for n, row in zip(full, rows):
                    identity[0, n], identity[1, n] = sets[n].sum(dtype=np.uint64), mix(sets[n]).sum(dtype=np.uint64)
                    signed[n] = row.tobytes()
            size = np.array([len(s) for s in sets], np.int64)
            columns = [block.column("doc_id"), block.column("t"), pa.array(size), *[pa.array(i.view(np.int64)) for i in identity]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signed, pa.binary())], ["doc_id", "t", "n_shingles", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "doc_id long, t long, n_shingles long, h1 long, h2 long, sig binary")


def index_rows(classes: DataFrame) -> DataFrame:
    """key and rep: every class under all its keys."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = index_keys(as_matrix(part.column("sig")))
                reps = np.repeat(part.column("rep").to_numpy(), SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


class Bucket:
    """One bucket read as a stream of members in order of their ids."""

    def __init__(self, key: int, size: int):
        self.key, self.pair = key, size == 2
        self.leaders, self.leader_ids = np.zeros((0, SLOTS), np.uint16), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Links every member to the nearest leader within the radius; notes those that found no place."""
        best, near = np.full(len(ids), SLOTS + 1), np.full(len(ids), -1)
        for n in range(len(self.leader_ids)):
            apart = distance(rows, self.leaders[n])
            closer = apart < best
            best[closer], near[closer] = apart[closer], self.leader_ids[n]
        at, chosen = 0, np.zeros(len(ids), bool)
        while len(self.leader_ids) < LEADERS:
            apart = np.flatnonzero(best[at:] > CLOSE)
            if not len(apart):
                break
            at += int(apart[0])
            self.leaders = np.vstack([self.leaders, rows[at : at + 1]])
            self.leader_ids = np.append(self.leader_ids, ids[at])
            chosen[at] = True
            apart = distance(rows[at + 1 :], rows[at])
            closer = np.flatnonzero(apart < best[at + 1 :]) + at + 1
            best[closer], near[closer] = apart[closer - at - 1], ids[at]
            at += 1
        linked = (best <= RADIUS) & (near != ids)
        lost = ~linked & ~chosen
        out.append((self.key, near[linked], ids[linked], best[linked], self.pair))
        out.append((self.key, np.full(lost.sum(), -1), ids[lost], np.full(lost.sum(), -1), self.pair))


def first_shared(matrix: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the SLOTS index keys is the first that each row of ``matrix`` shares with ``row``."""
    equal = (matrix == row).reshape(-1, CHUNKS, CHUNK_SLOTS)
    enough = equal.sum(axis=2) >= CHUNK_SLOTS - 1
    chunk = enough.argmax(axis=1)
    slots = equal[np.arange(len(equal)), chunk]
    wrong = np.where(slots.all(axis=1), 0, (~slots).argmax(axis=1))
    return np.where(enough.any(axis=1), chunk * CHUNK_SLOTS + wrong, -1)


def links_in_buckets(members: DataFrame) -> DataFrame:
    """key, a, b, apart, pair: links to the nearest leader; a is null for a member that found no place.

    ``pair`` marks buckets of two, which have no more than their link. ``members(key, rep, n, sig)``,
    n the size of the bucket, must be sorted by key and rep within its partitions.
    """

    def rows_of(out):
        key = np.concatenate([np.zeros(0, np.int64), *[np.broadcast_to(o[0], len(o[2])) for o in out]])
        pair = np.concatenate([np.zeros(0, bool), *[np.broadcast_to(o[4], len(o[2])) for o in out]])
        a, b, apart = (np.concatenate([np.zeros(0, np.int64), *[o[n] for o in out]]) for n in (1, 2, 3))
        missing = apart < 0
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(a, mask=missing), pa.array(b), pa.array(apart, mask=missing), pa.array(pair)],
            ["key", "a", "b", "apart", "pair"],
        )

    def run(batches):
        bucket = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, sizes = (batch.column(c).to_numpy() for c in ("key", "rep", "n"))
            rows, out = as_matrix(batch.column("sig")), []
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(heads[1:], len(keys))
            # buckets of two that lie within the batch are compared all at once
            pairs = heads[(ends - heads == 2) & (heads > 0) & (ends < len(keys))]
            apart = np.count_nonzero(rows[pairs] != rows[pairs + 1], axis=1)
            near = pairs[apart <= RADIUS]
            out.append((keys[near], ids[near], ids[near + 1], apart[apart <= RADIUS], True))
            done = set(pairs.tolist())
            for start, end in zip(heads.tolist(), ends.tolist()):
                if start in done:
                    continue
                if bucket is None or bucket.key != keys[start]:
                    bucket = Bucket(int(keys[start]), int(sizes[start]))
                bucket.add(ids[start:end], rows[start:end], out)
            yield rows_of(out)

    return members.mapInArrow(run, "key long, a long, b long, apart long, pair boolean")


def pairs_across(members: DataFrame, nearest: bool) -> DataFrame:
    """a, b within the radius but in different components, from blocks (key, low, high) of buckets.

    With ``nearest`` only the nearest such partner of each member of a block, else all.
    """

    def run(batches):
        held, group = [], None

        def compare():
            ids, part, comp, rows, fine = (np.concatenate(c) for c in zip(*held))
            key, low, high = group
            own = int(np.flatnonzero(index_keys(rows[:1])[0] == key)[0])
            known = fine.any(axis=1)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in range(len(ids)):
                ahead = nearest or ids > ids[n] if low == high else (part != part[n] if nearest else part > part[n])
                other = np.flatnonzero((comp != comp[n]) & ahead)
                apart = distance(rows[other], rows[n])
                close = np.flatnonzero(apart <= RADIUS)
                close = close[first_shared(rows[other[close]], rows[n]) == own]
                other, apart = other[close], apart[close]
                if known[n] and len(other):
                    further = np.where(known[other], np.count_nonzero(fine[other] != fine[n], axis=1), 0)
                    other, apart = other[further <= FINE_RADIUS], further[further <= FINE_RADIUS]
                if nearest and len(other) > 1:
                    other = other[[apart.argmin()]]
                a.append(np.minimum(ids[n], ids[other]))
                b.append(np.maximum(ids[n], ids[other]))
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, ids, part, comp = (batch.column(c).to_numpy() for c in ("key", "low", "high", "rep", "part", "component"))
            rows, packed = as_matrix(batch.column("sig")), batch.column("fine")
            fine = np.frombuffer(b"".join(f or bytes(FINE // 2) for f in packed.to_pylist()), np.uint8).reshape(-1, FINE // 2)
            fine = np.concatenate((fine >> 4, fine & 15), axis=1)
            change = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            heads = np.flatnonzero(np.append(True, change))
            for start, end in zip(heads, np.append(heads[1:], len(key))):
                if group != (key[start], low[start], high[start]):
                    if held:
                        yield compare()
                    held, group = [], (key[start], low[start], high[start])
                held.append((ids[start:end], part[start:end], comp[start:end], rows[start:end], fine[start:end]))
        if held:
            yield compare()

    return members.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """id, set (sorted hashes) and fine signature of the classes in ``ids(id)``, from the row (doc_id, t) that stands for each."""

    def run(batches):
        for block in blocks(batches):
            sets = shingle_sets(block.column("text"))
            columns = [block.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(fine_signatures(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set", "fine"])

    wanted = classes.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("rep").alias("id"), "doc_id", "t", "repeated")
    texts = docs.join(wanted, ["doc_id", "t"]).select("id", "repeated", "text")
    once = texts.where("not repeated").select("id", "text")
    again = texts.where("repeated").groupBy("id").agg(F.first("text").alias("text"))
    return materialize(once.unionByName(again).mapInArrow(run, "id long, set binary, fine binary"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs, each given once, with 100 * intersection >= share * union of their full sets."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"))


def members_of_open_buckets(members: DataFrame, linked: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the buckets ``members(key, rep, n)`` that hold several components, large ones dealt into blocks."""
    placed = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    return (
        placed.join(mixed, "key", "left_semi")
        .withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "rep", "part", "component")
        .join(classes.select("rep", "sig"), "rep")
        .join(sets.select(F.col("id").alias("rep"), "fine"), "rep", "left")
        .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    )


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def placed_rows(docs: DataFrame, share: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, component_id and kept of every row.

    Of a component the class with the smallest id is kept, and of that the row with that id and the smallest t.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), text_hash(text_column).alias("t"))
    known = materialize(describe(texts))
    identity = ["h1", "h2", "n_shingles"]
    usable = known.where("sig is not null and doc_id is not null")
    stands = F.min(F.struct("doc_id", "t"))
    found = usable.groupBy(*identity).agg(stands.alias("s"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"))
    # a class of several rows may have its id and text more than once
    classes = materialize(found.select(*identity, F.xxhash64(*identity).alias("rep"), "s.doc_id", "s.t", (F.col("rows") > 1).alias("repeated"), "sig"))

    counted = F.count(F.lit(1)).over(Window.partitionBy("key"))
    company = materialize(index_rows(classes).withColumn("n", counted).where("n > 1"))
    signed = company.join(classes.select("rep", "sig"), "rep")
    sorted_members = signed.select("key", "rep", "n", "sig").repartition("key").sortWithinPartitions("key", "rep")
    links = materialize(links_in_buckets(sorted_members))
    reps = texts.where("doc_id is not null")
    # a bucket of two has no more than its link, which is tried whatever better links there are
    best = Window.partitionBy("b").orderBy("apart", "a")
    pairs = materialize(links.where("a is not null").groupBy("a", "b").agg(F.min("apart").alias("apart"), F.max("pair").alias("pair")))
    tried = materialize(pairs.withColumn("_best", F.row_number().over(best)).where(f"_best <= {LINKS} or pair").select("a", "b"))
    sets = full_sets(reps, ends_of(pairs), classes)
    linked = components(confirm(tried, sets, share))
    keys = links.where("not pair").select("key").distinct()
    members = materialize(company.where("n > 2").join(keys, "key", "left_semi"))
    for nearest in (True, False):
        spread = members_of_open_buckets(members, linked, classes, sets)
        more = materialize(pairs_across(spread, nearest).distinct().join(tried, ["a", "b"], "left_anti"))
        unknown = materialize(ends_of(more).join(sets.select("id"), "id", "left_anti"))
        if unknown.head() is not None:
            sets = sets.unionByName(full_sets(reps, unknown, classes))
        found = confirm(more, sets, share)
        tried = tried.unionByName(more)
        if found.head() is not None:
            # the stars of the components known so far stand for their links
            stars = linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            linked = components(stars.unionByName(found))

    owners = linked.join(classes.select(F.col("rep").alias("node"), "doc_id", "t"), "node")
    owners = owners.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("owner"))
    owned = linked.join(owners, "component").select(F.col("node").alias("rep"), "owner")
    placed = classes.join(owned, "rep", "left").select(*identity, F.coalesce("owner", F.struct("doc_id", "t")).alias("owner"))
    found = known.join(placed, identity, "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(usable, F.col("owner.doc_id")).when(F.col("n_shingles") == 0, F.col("doc_id"))
    kept = ~usable | ((F.col("doc_id") == F.col("owner.doc_id")) & (F.col("t") == F.col("owner.t")))
    return found.select("doc_id", "t", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, share: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return placed_rows(docs, share, id_column, text_column).drop("t")


def drop_near_copies(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that are kept, with all their columns."""
    names = docs.columns
    placed = materialize(placed_rows(docs, share))
    gone = placed.where("not kept").select("doc_id", "t").distinct()
    counted = placed.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("n > 1").select("doc_id", "t"))
    hashed, own = "_t", "_doc_id"
    while {hashed, own} & set(names):
        hashed, own = hashed + "_", own + "_"
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), hashed: text_hash()})

    def met(keys):
        return keys.select(F.col("doc_id").alias(own), F.col("t").alias(hashed))

    rows = rows.join(met(gone), [own, hashed], "left_anti")
    if repeated.head() is None:
        return rows.select(*names)
    once = rows.join(met(repeated), [own, hashed], "left_anti")
    again = rows.join(F.broadcast(met(repeated)) if repeated.count() < 10_000 else met(repeated), [own, hashed], "left_semi")
    firsts = again.groupBy(own, hashed).agg(F.first(F.struct(*names)).alias("_row")).select("_row.*")
    return once.select(*names).unionByName(firsts)


def op1_near_dedup(spark, sf):
    """Contract query: every document with its set size and component at a similarity of 0.75; kept tells whether it gives
    its component the name, also where an id stands on several texts."""
    found = near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
