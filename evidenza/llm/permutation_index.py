"""Approximate nearest neighbours by a permutation index.

Vectors of the sample become pivots, near copies left out. A vector stands for itself by its nearest pivots in
order, its permutation: rows by POSTED of them, queries by ASKED. A row is posted in the inverted files of its own
pivots. The files are kept in shards of pivots that lie near each other; a row is sent to the shards of its pivots, a
query to the shards of its own and to no other. There it reads the files of its pivots alone. A pair that could meet
in several shards is taken in that of the row's nearest pivot that the query knows. The rows met are ranked by the
footrule distance of the permutations over the row's pivots: how far each stands from its place in the query's, one
that the query does not know counting as behind its last. Of each shard the best SHARE (ties included, at least as many
as are asked for) are ranked again by the exact inner product in double precision; the best of all shards win.

There are about a twelfth as many pivots as rows, up to PIVOTS, so the share of the rows that a query reads falls
while they grow: see the README for measured recall and shares. A shard with many rows is split into blocks, one
with many queries into groups, so the memory of a task is bounded by BLOCK and QUERIES.

Inner products become angles by one more component that brings all vectors to the largest length, so
permutations also fit vectors of unequal lengths. Components are divided by the largest of all first.

Bounds on the driver and in the broadcast: 2 * PIVOTS sampled vectors of each size, PIVOTS of them pivots.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows without vec_id take
no part; a vector meets only vectors of its own size; a query never finds rows of its own vec_id; repeated rows are
found as often as they stand there; rows that share a query's vec_id ask once, with the least of their vectors; ties
go to the smaller vec_id; fewer candidates than asked for are all returned; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, arrow_batches, once, table
from .vectors import stacked, taking_part

PIVOTS, POSTED, ASKED, SHARE = 4096, 8, 256, 0.6
#: Least pivots, rows to a pivot, rows to a shard; rows and queries of a task.
FEWEST, ROWS_PER_PIVOT, ROWS_PER_SHARD = 64, 12, 32768
BLOCK, QUERIES = 16384, 2048


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """The first rows of the sample, scaled to length 1, that are no near copies of earlier ones."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    kept, n = np.empty((min(most, len(unit)), unit.shape[1])), 0
    for row in unit:
        if n < most and (not n or (kept[:n] @ row).max() < 0.95):
            kept[n] = row
            n += 1
    return kept[:n]


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    near = -(vectors @ pivots.T)
    if nearest >= len(pivots):
        return np.argsort(near, axis=1, kind="stable")
    some = np.sort(np.argpartition(near, nearest - 1, axis=1)[:, :nearest], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


@dataclass
class Pivots:
    """Pivots for vectors of one size, the shard of each, and what brings vectors to one length."""

    at: np.ndarray
    shard: np.ndarray
    scale: float
    longest: float

    @classmethod
    def of(cls, sample: np.ndarray, scale: float, longest: float, rows: int, most: int) -> Pivots:
        empty = cls(np.empty((0, 0)), np.empty(0, "int64"), scale, longest)
        at = choose_pivots(empty.raised(sample), most)
        anchors = max(1, min(len(at) // 16, rows // ROWS_PER_SHARD))
        return cls(at, (at @ at[:anchors].T).argmax(1), scale, longest)

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1, keepdims=True), 0))], 1)

    def orders(self, x: np.ndarray, nearest: int, queries: bool) -> np.ndarray:
        x = np.concatenate([x / np.abs(x).max(1, keepdims=True), np.zeros((len(x), 1))], 1) if queries else self.raised(x)
        return permutations(x, self.at, nearest)


class Files:
    """Inverted files of one block of a shard: for each of the shard's pivots the rows posted there."""

    def __init__(self, order: np.ndarray, shard_of: np.ndarray, shard: int):
        self.mine, self.rows = shard_of == shard, len(order)
        row, position = np.nonzero(self.mine[order])
        pivot = order[row, position]
        by = np.argsort(pivot, kind="stable")
        self.row, self.cuts = row[by], np.searchsorted(pivot[by], np.arange(len(shard_of) + 1)).tolist()
        self.at = np.ascontiguousarray(order.T)  # the rows' nearest pivots, their second ones, and so on

    def near(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows met by a query that are this shard's to rank, and their footrule distances to it."""
        asked = len(order)
        met = np.zeros(self.rows, bool)
        for pivot in order[self.mine[order]].tolist():
            met[self.row[self.cuts[pivot] : self.cuts[pivot + 1]]] = True
        rows = np.flatnonzero(met)
        place = np.full(len(self.mine), asked, "int32")
        place[order] = np.arange(asked)
        if not self.mine.all():  # a pair is taken in the shard of the row's first pivot that the query knows
            own, open_ = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for at in self.at:
                pivot = at[rows]
                known = open_ & (place[pivot] < asked)
                own |= known & self.mine[pivot]
                open_ &= ~known
            rows = rows[own]
        far = np.zeros(len(rows), "int64")
        for j, at in enumerate(self.at):
            far += np.abs(place - j)[at[rows]]
        return rows, far


def _search(k: int, sent, share: float):
    out = ["query_id", "vec_id", "score"]

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: [] for c in out})
        rows = rows.sort_values("vec_id", kind="stable")
        ids, x, q = rows["vec_id"].to_numpy(), stacked(rows["vector"]), stacked(queries["vector"])
        files = Files(np.stack(rows["order"].tolist()), sent.value[key[0]].shard, key[1])
        found: list[list[np.ndarray]] = []
        for query, own, order in zip(queries["query_id"].to_numpy(), q, queries["order"], strict=True):
            near, far = files.near(np.asarray(order))
            others = ids[near] != query
            near, far = near[others], far[others]
            if not len(near):
                continue
            n = min(len(near), max(k, int(np.ceil(share * len(near)))))
            near = near[far <= np.partition(far, n - 1)[n - 1]]
            score = (x[near] * own).sum(1)
            if len(near) > k:
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                near, score = near[high], score[high]
            best = np.lexsort((ids[near], -score))[:k]
            found.append([np.full(len(best), query), ids[near][best], score[best]])
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) if found else [] for i, c in enumerate(out)})

    return run


def fit(known: DataFrame, most: int = PIVOTS) -> dict[int, Pivots]:
    """Pivots for each size of the vectors (vec_id, size, vector), from samples drawn by a hash of vec_id."""
    largest = F.aggregate("vector", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v.cast("double"))))
    sizes = known.groupBy("size").agg(F.count("*").alias("n"), F.max(largest).alias("scale"))
    draw = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30))
    pivots = F.least(F.lit(most), F.greatest(F.lit(FEWEST), F.ceil(F.col("n") / ROWS_PER_PIVOT)))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + (v.cast("double") / F.col("scale")) * (v.cast("double") / F.col("scale")))
    scaled = known.join(sizes, "size")
    longest = scaled.groupBy("size", "n", "scale", pivots.alias("pivots")).agg(F.sqrt(F.max(squares)).alias("longest")).collect()
    drawn = scaled.filter(draw < F.ceil(4 * pivots / F.col("n") * (1 << 30)))
    drawn = drawn.groupBy("size", "vec_id").agg(F.min("vector").alias("vector"), F.first(pivots).alias("pivots"))
    order = Window.partitionBy("size").orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id")
    sample = drawn.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 2 * F.col("pivots")).select("size", "at", "vector").collect()
    held: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: (r["size"], r["at"])):
        held.setdefault(r["size"], []).append(r["vector"])
    return {r["size"]: Pivots.of(np.array(held[r["size"]], "float64"), r["scale"], r["longest"], r["n"], r["pivots"]) for r in longest}


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, posted: int = POSTED, asked: int = ASKED, share: float = SHARE, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows (vec_id, embedding) of largest inner product found for each query (vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "permutations")
    usable = lambda df: df.filter(taking_part("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.size("embedding").alias("size"), F.col("embedding").alias("vector"))
    known = usable(rows)
    sent = spark.sparkContext.broadcast(fit(known, pivots))

    def orders(nearest: int, ask: bool):
        @F.pandas_udf("struct<order:array<int>,shards:array<int>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                order, shards, sizes = [None] * len(vectors), [None] * len(vectors), vectors.map(len).to_numpy()
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    if int(n) not in sent.value:  # a query of a size that no row has
                        continue
                    own = sent.value[int(n)]
                    for i, found in zip(at, own.orders(stacked(vectors.iloc[at]), nearest, ask).astype("int32"), strict=True):
                        order[i], shards[i] = found, np.unique(own.shard[found]).astype("int32")
                yield pd.DataFrame({"order": order, "shards": shards})

        return once(run)("vector")

    key = ["size", "shard"]
    left = known.select("vec_id", "size", "vector", orders(posted, False).alias("at"), F.monotonically_increasing_id().alias("row"))
    left = scratch.save(left.select("vec_id", "size", "vector", "at.order", "row", F.explode("at.shards").alias("shard")))
    right = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("size", "vector")).alias("v")).select("query_id", "v.*")
    right = right.select("query_id", "size", "vector", orders(asked, True).alias("at"))
    right = scratch.save(right.select("query_id", "size", "vector", "at.order", F.explode("at.shards").alias("shard")))
    n_rows, n_queries = left.groupBy(*key).agg(F.count("*").alias("n")), right.groupBy(*key).agg(F.count("*").alias("m"))
    loads = n_rows.join(n_queries, key).select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / group).cast("int").alias("groups"))
    loads = F.broadcast(scratch.save(loads))  # at most PIVOTS / 16 rows for each size of vectors
    dealt = lambda n, *columns: F.pmod(F.xxhash64(F.lit("deal"), *columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(loads, key).withColumn("block", dealt("blocks", "vec_id", "row")).withColumn("part", every("groups")).select(*key, "block", "part", "vec_id", "vector", "order")
    right = right.join(loads, key).withColumn("part", dealt("groups", "query_id")).withColumn("block", every("blocks")).select(*key, "block", "part", "query_id", "vector", "order")
    unit = [*key, "block", "part"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(_search(k, sent, share), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.filter(F.col("vec_id") % 20 == 0))
