"""Connected components of a link table, labelled by the smallest node of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, trim, written

#: Links that a task joins at once.
LINKS = 1 << 19


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components as stars: the smallest node of each beside every other one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    hangs = root < np.arange(len(nodes))
    return nodes[root[hangs]], nodes[hangs]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of a task as stars, LINKS at a time."""
    held, n = [], 0

    def stars() -> Iterator[pa.RecordBatch]:
        low, high = _stars(*(np.concatenate([x[k] for x in held]) for k in range(2)))
        for s in range(0, len(low), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(low[s : s + (1 << 16)]), pa.array(high[s : s + (1 << 16)])], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= LINKS:
            yield from stars()
            held, n = [], 0
    if n:
        yield from stars()
    trim()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; columns ``a`` and ``b`` of ``links``, a written table, are long.

    Links are first joined inside tasks, in blocks of LINKS, and go on as stars: a
    block of any shape leaves one link for each of its nodes at most. Alternating
    star contraction connects the blocks: each round hangs larger neighbours on the
    smallest one seen, first over all neighbours, then over the smaller ones, until
    all links are stars. Minima are pre-aggregated, so for them a node with very
    many links costs one row per task; where its links meet its minimum they are
    two numbers each, and adaptive execution splits them. Each round is a written
    table.
    """
    proper = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = written(proper.coalesce(max(1, -(-links.count() // LINKS))).mapInArrow(_joined, "a long, b long"), "links")
    while True:
        # stars: no node hangs on two others, and none that hangs has others hanging on it
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("a", F.lit(0), F.lit(1)))
        left = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR (hangs > 0 AND holds > 0)")
        if not left.take(1):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(small_low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
        new = written(hung.select("e.a", "e.b").where("a < b").distinct(), "stars")
        forget(edges)
        edges = new
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
