"""Detectors and pattern catalogs brought by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.overlap import select_non_overlapping

HITS = (
    "seq_id bigint, seq_name string, seq_len bigint, class string, subclass string, start bigint, end bigint, "
    "length bigint, sequence string, score double"
)


@dataclass
class Detector:
    """A class name and a table function: bases -> (start, end, subclass, score), 0-based half-open."""

    name: str
    find: Callable[[str], Iterable[tuple[int, int, str, float]]]
    threshold: float = 0.5


def run_detector(sequences: DataFrame, detector: Detector, resolve: bool = True) -> DataFrame:
    """Motifs of one user detector over (seq_id, seq_name, bases), whole sequences or windows of them.

    Hits below the threshold are dropped; of hits of one subclass that overlap, the best stays.
    """
    names = [field.split()[0] for field in HITS.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[field.split()[1]] for field in HITS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [
                (seq_id, name, len(bases), detector.name, subclass, start + 1, end, end - start, bases[start:end], float(score))
                for seq_id, name, bases in zip(*(c.to_pylist() for c in batch.columns))
                for start, end, subclass, score in detector.find(bases or "")
                if score >= detector.threshold
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    hits = sequences.select("seq_id", "seq_name", "bases").mapInArrow(run, HITS)
    if not resolve:
        return hits
    return select_non_overlapping(hits, ["subclass"], [-F.col("score"), -F.col("length"), F.col("start")], binned=False)


def pattern_rows(catalog: DataFrame | list[tuple]) -> list[tuple]:
    """(class, pattern_id, subclass, regex) rows of a catalog table (``catalogs.from_json``, ``catalogs.catalog``).

    A catalog is a list of patterns written by people and travels with the tasks.
    """
    if isinstance(catalog, list):
        return catalog
    rows = catalog.select("class", "pattern_id", "subclass", "regex").where("regex is not null and regex <> ''").collect()
    return [tuple(r) for r in rows]
