"""Connected components by alternating star contraction: only edges move, no vertex gathers its component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, smallest node it reaches) of the given edges, loops left out."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(ids):
        return ids, ids
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _contract(batches):
    for batch in batches:
        node, low = local_forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Rows (node, component): each node of the edges (a, b, both long) with the smallest node it reaches.

    Loops, repeated and reversed edges are harmless; no edges give no rows. Each round a node's larger neighbours are
    hung below its smallest one (large star), then a node's smaller neighbours likewise (small star). Both sides of a
    round only group by one column with a map-side minimum, so a node with very many neighbours is never gathered. The
    edge table is written to the shared folder every round, and the loop ends when a round leaves it unchanged.
    """
    now = scratch.keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").filter("u <> m").union(low.select("u", "m")).distinct()
        after = scratch.keep(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        # a is always larger than b; a forest of stars has one edge a node, and no b that is also an a
        stars = after.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        chained = after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() if (stars or 0) == 1 else 1
        for old in (now, large):
            scratch.drop(old)
        now = after
        if (stars or 0) <= 1 and not (stars and chained):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
