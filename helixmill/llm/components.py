"""Connected components of a table of links: contraction inside tasks, then large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import materialize

BLOCK_LINKS = 1 << 18


def least_of_part(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the links and the smallest node that each one reaches through them."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # the label itself is lowered too, so whole trees are hooked on at once
        for place in (label[x], label[y], x, y):
            np.minimum.at(new, place, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def contracted(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: blocks of at most BLOCK_LINKS written links become stars around their smallest nodes.

    Never more links than before; what links connect stays connected. As many tasks as there are blocks, so that
    links that lie in many small files meet; a task holds one block, whatever the number of links.
    """
    blocks = -(-links.count() // BLOCK_LINKS)

    def run(batches):
        held, size = [], 0

        def stars():
            u, v = least_of_part(*(np.concatenate(c) for c in zip(*held)))
            leaf = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[leaf]), pa.array(v[leaf])], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_LINKS):
                part = batch.slice(at, BLOCK_LINKS)
                held.append([part.column(n).to_numpy() for n in (0, 1)])
                size += part.num_rows
                if size >= BLOCK_LINKS:
                    yield stars()
                    held, size = [], 0
        if size:
            yield stars()

    return materialize(links.coalesce(max(1, blocks)).mapInArrow(run, "u long, v long"))


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another.

    ``links`` is a written table. Null ends are no links. A step contracts blocks of links without a shuffle, asks by one aggregate whether every node is
    a centre or a leaf of one star, and if not joins the larger neighbours of every node to its
    smallest and the smaller ones to each other's smallest. Links never grow in number and distances
    halve, so a few steps do even for long chains. A node with very many links
    is summed before the shuffle and joined back by a join that can be split; nothing but the
    question whether a node is left between stars reaches the driver.
    """
    long = [F.col(c).cast("long") for c in (first, second)]
    edges = contracted(links.dropna(subset=[first, second]).where(F.col(first) != F.col(second)).select(*long))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = materialize(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
        if nodes.where("lo < u and lo < hi").head() is None:
            return nodes.select(F.col("u").alias("node"), F.least("u", "lo").alias("component"))
        large = both.join(nodes.select("u", F.least("u", "lo").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = contracted(materialize(small.unionByName(down.select("u", F.col("m").alias("v")))))
