"""Permutation enrichment: motif density against shuffled sequences."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixmill.operators.digests import LONGEST, numbered_digests
from helixmill.operators.stats import genomic_density
from helixmill.session import materialize


def _mixed(bases: str, salt: str) -> str:
    """``bases`` in the order of the md5 of salt and position."""
    keys = b"".join([md5(b"%s%d" % (salt.encode(), n)).digest() for n in range(len(bases))])
    high, low = np.frombuffer(keys, ">u8").reshape(-1, 2).T
    order = np.lexsort((low, high))
    return "".join(np.array(list(bases))[order].tolist())


GROUP_LEN = 1 << 16


def _groups(sizes: list[int]):
    """Runs of rows that hold about ``GROUP_LEN`` bases together, as (first, one behind the last)."""
    first, held = 0, 0
    for n, size in enumerate(sizes):
        held += size
        if held >= GROUP_LEN:
            yield first, n + 1
            first, held = n + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _mixed_group(bases: list[str], salts: list[str]) -> list[str]:
    """``_mixed`` of several texts, whose keys are computed together."""
    prefixes, sizes = [salt.encode() for salt in salts], [len(text) for text in bases]
    if max(map(len, prefixes)) + len(str(max(sizes))) > LONGEST:
        return [_mixed(*pair) for pair in zip(bases, salts)]
    keys, out = np.split(numbered_digests(prefixes, sizes), np.cumsum(sizes)[:-1]), []
    for text, salt, key in zip(bases, salts, keys):
        order = np.argsort(key)
        ranked = key[order]
        if not text.isascii() or (ranked[1:] == ranked[:-1]).any():  # the second half of the md5 decides
            out.append(_mixed(text, salt))
        else:
            out.append(np.frombuffer(text.encode(), np.uint8)[order].tobytes().decode())
    return out


@F.pandas_udf(StringType())
def _mixed_texts(bases: pd.Series, salt: pd.Series) -> pd.Series:
    out = bases.astype(object).copy()
    filled = np.flatnonzero(bases.fillna("").str.len().to_numpy() > 0)
    texts, salts = bases.iloc[filled].tolist(), salt.iloc[filled].tolist()
    for lo, hi in _groups([len(text) for text in texts]):
        for at, mixed in zip(filled[lo:hi], _mixed_group(texts[lo:hi], salts[lo:hi])):
            out.iat[at] = mixed
    return out


def shuffled(bases: Column, *salt: Column) -> Column:
    """Bases in the order of md5(salt_position): a permutation that any engine can repeat."""
    return _mixed_texts(bases, F.concat_ws("_", *[s.cast("string") for s in salt], F.lit("")))


def _copy_id() -> Column:
    return F.xxhash64("origin_id", "iteration")


def shuffle_sequences(sequences: DataFrame, n_shuffles: int, seed: int = 42) -> DataFrame:
    """n shuffled copies per sequence, as ordinary sequence rows with a new seq_id."""
    copies = sequences.select("seq_id", "seq_name", F.upper("bases").alias("bases"), F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("iteration"))
    mixed = copies.select(
        F.col("seq_id").alias("origin_id"),
        "iteration",
        shuffled(F.col("bases"), F.lit(seed), F.col("seq_id"), F.col("iteration")).alias("mixed"),
    )
    return mixed.select(
        _copy_id().alias("seq_id"),
        F.concat_ws("_", F.lit("shuffled"), "iteration").alias("seq_name"),
        "origin_id",
        "iteration",
        F.col("mixed").alias("bases"),
    )


def enrichment(
    sequences: DataFrame, detect: Callable[[DataFrame], DataFrame], n_shuffles: int = 100, seed: int = 42
) -> DataFrame:
    """Fold enrichment and permutation p-value per sequence and observed class, plus Overall.

    ``detect`` maps sequences to motifs; shuffled copies are ordinary rows of the same pipeline,
    so the whole background is one job. Iterations without a motif of a class count as zero.
    Motifs of sequences and of copies are written once; a copy is as long as its sequence, so
    lengths need no copies.
    """
    copies = shuffle_sequences(sequences, n_shuffles, seed)
    lengths = materialize(sequences.select("seq_id", F.length("bases").alias("seq_len")))
    observed_motifs = materialize(detect(sequences))
    observed = genomic_density(observed_motifs, lengths).withColumnRenamed("density_percent", "observed_density")
    numbered = lengths.withColumnRenamed("seq_id", "origin_id").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    ids = numbered.select(_copy_id().alias("seq_id"), "origin_id", "iteration", "seq_len")
    background = (
        genomic_density(materialize(detect(copies.drop("origin_id", "iteration"))), ids)
        .join(ids.select("seq_id", "origin_id", "iteration"), "seq_id")
        .select(F.col("origin_id").alias("seq_id"), "class", "iteration", F.col("density_percent").alias("bg"))
    )
    grid = observed.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    bg = F.coalesce("bg", F.lit(0.0))
    filled = grid.join(background, ["seq_id", "class", "iteration"], "left").groupBy("seq_id", "class", "observed_density").agg(
        F.avg(bg).alias("mean"), F.stddev_pop(bg).alias("std"), F.avg((bg >= F.col("observed_density")).cast("double")).alias("p")
    )
    counts = observed_motifs.rollup("seq_id", "class").agg(F.count(F.lit(1)).alias("observed_count"), F.grouping_id().alias("g")).where("g < 3")
    counts = counts.select("seq_id", F.when(F.col("g") == 1, "Overall").otherwise(F.col("class")).alias("class"), "observed_count")
    fold = (
        F.when(F.col("mean") > 0, F.round(F.col("observed_density") / F.col("mean"), 2))
        .when(F.col("observed_density") > 0, F.lit(float("inf")))
        .otherwise(F.lit(1.0))
    )
    return filled.join(counts, ["seq_id", "class"], "left").select(
        "seq_id",
        "class",
        "observed_density",
        F.round("mean", 4).alias("background_mean"),
        F.round("std", 4).alias("background_std"),
        fold.alias("fold_enrichment"),
        F.round("p", 4).alias("p_value"),
        F.lit(n_shuffles).alias("n_shuffles"),
        F.coalesce("observed_count", F.lit(0)).alias("observed_count"),
    )
