"""Connected components of a graph given as edges, by union-find within blocks and alternating large and small stars.

Edges are dealt into blocks of at most BLOCK_EDGES; each block is replaced by a star for each of its parts, found
in numpy in memory bounded by the block. Where one block holds all edges, its stars are the components. Otherwise
rounds of large and small stars, equi-joins and minima over the edges written to the shared folder, go on until the
stars stand still; nothing is collected but a count and a checksum. Hubs are reduced to minima before each shuffle.

Defined cases: an edge with a null end is left out; repeated edges and loops change nothing; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, brief_shuffles

#: Edges of a block: 16 MB of ids.
BLOCK_EDGES = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position of the part of each of n positions, of which a and b are linked.

    Every root that has a smaller neighbour is hung under the smallest one; links between different roots stay for
    the next round.
    """
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's edges as (u, v): v the smallest node of u's part of the block."""
    held = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(len(nodes), at[: len(u)], at[len(u) :])
    some = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(some), 1 << 16):
        part = some[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[part], pa.int64()), "v": pa.array(nodes[root[part]], pa.int64())})


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, block: int = BLOCK_EDGES) -> DataFrame:
    """(node, component): the smallest node that edges (u, v) reach; nodes that are their own component are left out."""
    now, known = scratch.save(edges.filter("u <> v")), None
    while True:
        with brief_shuffles(scratch.spark):
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        blocks = -(-seen[0] // block)
        if seen == known or not blocks:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        stars = now.repartition(blocks).mapInArrow(_stars, "u long, v long")
        if blocks == 1:
            return scratch.save(stars).select(F.col("u").alias("node"), F.col("v").alias("component"))
        known = seen
        then = scratch.save(_small(_large(stars)))
        scratch.drop(now)
        now = then
