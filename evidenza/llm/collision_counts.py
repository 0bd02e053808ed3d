"""Embedding near-duplicates by counting collisions of projections.

Unit vectors are projected on many fixed random lines. Two vectors collide on a line if one lies within a
window centred on the other. A pair at the least cosine collides on a line with a known chance, so the count
of collisions that all but MISS of such pairs reach is known too: pairs that reach it are verified by their
exact cosine in double precision, all others are far apart.

No line alone parts strangers, whose projections crowd in its middle, so K lines are taken together in each of T
tables. A table sorts its lines into two ranges each, which overlap by one window: a vector stands in its own range
of every line and, if it lies within a window above the cut, also as a guest in the range below. A pair within the
window on all K lines so meets in exactly one place of the table: the one where on no line both are guests. There
the rows are sorted by the first line; the window of each reaches over the next ones, and for these the collisions
are counted, on COUNTED[0] lines and, if they may still reach the count, on COUNTED[1]. K follows from the size of the
largest label, T from K: a pair at the least cosine is within the windows of some table but for a chance of MISS.
A pair is counted in the first such table and in no other. Lines are cut at the median of a sample of SAMPLE vectors
drawn by a hash; the cuts bear on the time taken, not on the result.

Copies of one vector within a label (by a 128-bit hash of it) are one vector with a weight. A place with many
vectors is split into blocks whose pairs of blocks are separate pieces of work, dealt with many small places into
bins of bounded size; a bin returns no pairs but, for each vector, the weight of its links and the root of its
part, so a large cluster costs numpy time, not rows.

Defined cases: vectors without a label, or null, empty, zero or with null or non-finite components, link
with nothing, and stand as their own component; vectors of different sizes never link; rows that share a
vec_id are linked by their component; a null vec_id has a null component; repeated rows are copies of each
other; an empty table gives an empty result; columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, arrow_batches, once, table
from .components import components, roots
from .vectors import stacked, taking_part

#: Chance to overlook a pair at the least cosine: in all tables, and by either count.
MISS = 1e-5
#: The window in deviations of a pair at the least cosine; lines counted first and in all.
WINDOW, COUNTED = 2.5, (8, 24)
#: Rows of a place aimed at, of a block, of a bin; vectors that fix the cuts; rows handled at once in a place.
PLACE, BLOCK, BIN, SAMPLE, STRIP = 512, 4096, 4096, 4096, 256
#: Share of the rows that a range of a line holds with its guests, about.
SHARE = 0.6


def least_count(n: int, p: float) -> int:
    """The largest count that a binomial falls short of with a chance of MISS at most."""
    below, k, chance = 0.0, 0, (1 - p) ** n
    while k < n and below + chance <= MISS:
        below += chance
        chance *= (n - k) / (k + 1) * p / (1 - p)
        k += 1
    return k


@dataclass(frozen=True)
class Lines:
    """The lines, ranges and counts."""

    cosine: float
    tables: int
    per_table: int
    window: float
    least: tuple[int, int]
    cuts: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def calibrated(cls, cosine: float, largest: int) -> Lines:
        apart = math.sqrt(2 - 2 * cosine)  # distance of unit vectors at the least cosine; a line sees a normal with this deviation
        inside = math.erf(WINDOW / math.sqrt(2))
        per_table = min(40, max(1, math.ceil(math.log(max(largest, 2) / PLACE) / -math.log(SHARE))))
        tables = math.ceil(math.log(MISS) / math.log(1 - inside**per_table))
        return cls(cosine, tables, per_table, WINDOW * apart, tuple(least_count(n, inside) for n in COUNTED))

    @property
    def sorted_lines(self) -> int:
        return self.tables * self.per_table

    def project(self, unit: np.ndarray) -> np.ndarray:
        """Places on the lines of the tables, table after table, then on those for the count."""
        return unit @ np.random.default_rng(2).normal(size=(unit.shape[1], self.sorted_lines + COUNTED[1]))

    def fit(self, sample: np.ndarray) -> None:
        self.cuts[sample.shape[1]] = np.median(self.project(sample)[:, : self.sorted_lines], 0)

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, table, place, guest): where each row stands; `guest` has a bit for each line on which it is a guest there."""
        projected, found = self.project(unit), []
        cuts = self.cuts.get(unit.shape[1], np.zeros(self.sorted_lines))
        for t in range(self.tables):
            row = np.arange(len(unit))
            place, guest = np.zeros(len(unit), "int64"), np.zeros(len(unit), "int64")
            for k in range(self.per_table):
                above = projected[row, t * self.per_table + k] - cuts[t * self.per_table + k]
                also = np.flatnonzero((above >= 0) & (above < self.window))
                place = 2 * np.concatenate([place, place[also]]) + np.concatenate([above >= 0, np.zeros(len(also), bool)])
                row, guest = np.concatenate([row, row[also]]), np.concatenate([guest, guest[also] | 1 << k])
            found.append((row, np.full(len(row), t), place, guest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = stacked(vectors)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _met(lines: Lines, x: np.ndarray, projected: np.ndarray, rows: np.ndarray, table_of: int, guest: np.ndarray, side: np.ndarray | None):
    """Linked pairs of one piece of work, as positions; of two blocks (`side`) only pairs of one and the other."""
    first = projected[rows, table_of * lines.per_table]
    order = np.argsort(first, kind="stable")
    rows, first, guest = rows[order], first[order], guest[order]
    side = side[order] if side is not None else None
    few, all_ = (slice(lines.sorted_lines, lines.sorted_lines + n) for n in COUNTED)
    counted = np.ascontiguousarray(projected[rows, few].T)
    until = np.searchsorted(first, first + lines.window, "right")
    for a in range(0, len(rows), STRIP):
        b, end = min(a + STRIP, len(rows)), int(until[min(a + STRIP, len(rows)) - 1])
        count = np.zeros((b - a, end - a), "int8")
        for line in counted:
            count += np.abs(line[a:b, None] - line[None, a:end]) <= lines.window
        i, j = np.nonzero(count >= lines.least[0])
        i, j = i + a, j + a
        ok = (j > i) & (j < until[i]) & (guest[i] & guest[j] == 0)
        if side is not None:
            ok &= side[i] != side[j]
        i, j = rows[i[ok]], rows[j[ok]]
        for s in range(0, len(i), 1 << 15):
            u, v = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            near = (np.abs(projected[u, all_] - projected[v, all_]) <= lines.window).sum(1) >= lines.least[1]
            u, v = u[near], v[near]
            within = (np.abs(projected[u, : lines.sorted_lines] - projected[v, : lines.sorted_lines]) <= lines.window).reshape(-1, lines.tables, lines.per_table).all(2)
            mine = within.any(1) & (within.argmax(1) == table_of)
            u, v = u[mine], v[mine]
            close = np.einsum("ij,ij->i", x[u], x[v]) >= lines.cosine
            yield u[close], v[close]


def _bin(lines: Lines):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["work", "rep"], kind="stable").reset_index(drop=True)
        ids, work = rows["rep"].to_numpy(), rows["work"].to_numpy()
        # a vector that stands in several pieces of work is read and projected once
        _, one = np.unique(ids, return_index=True)
        place = np.searchsorted(ids[one], ids)
        own, weight = ids[one], rows["weight"].to_numpy()[one]
        x = unit_rows(rows["vector"].iloc[one])
        projected = lines.project(x).astype("float32")
        links, left, right = np.zeros(len(own), "int64"), [], []
        cuts = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1], [True]]))
        table_of, two, side, guest = (rows[c].to_numpy() for c in ("tab", "two", "side", "guest"))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for u, v in _met(lines, x, projected, place[a:b], int(table_of[a]), guest[a:b], side[a:b] if two[a] else None):
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                left.append(u)
                right.append(v)
        if not left:
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        root = roots(len(own), np.concatenate(left), np.concatenate(right))
        some = links > 0
        return pd.DataFrame({"rep": own[some], "links": links[some], "root": own[root[some]]})

    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, label, embedding)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "collisions")
    ok = taking_part("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = ["label", "h1", "h2"]
    valid = rows.filter(ok).select("vec_id", F.col("label").cast("string").alias("label"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), F.col("embedding").alias("vector"))
    distinct = scratch.save(valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")))
    largest = distinct.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    lines = Lines.calibrated(cosine, largest)
    sample = pd.Series([r["vector"] for r in distinct.orderBy(F.xxhash64("rep", "label"), "rep", "label").select("vector").limit(SAMPLE).collect()], dtype=object)
    for n, part in sample.groupby(sample.map(len)) if len(sample) else ():
        lines.fit(unit_rows(part))

    @F.pandas_udf("array<struct<tab:int,place:long,guest:long>>")
    def places_of(vectors: pd.Series) -> pd.Series:
        out: list[list] = [[] for _ in range(len(vectors))]
        sizes = vectors.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for i, t, place, guest in zip(*(c.tolist() for c in lines.places(unit_rows(vectors.iloc[at]))), strict=True):
                out[at[i]].append({"tab": t, "place": place, "guest": guest})
        return pd.Series(out)

    hashed = F.xxhash64("label", F.size("vector"), "at.tab", "at.place")
    posted = distinct.select("rep", "label", "vector", F.explode(once(places_of)("vector")).alias("at")).select("rep", "at.tab", "at.guest", hashed.alias("key"))
    posted = scratch.save(posted)
    shared = posted.groupBy("key", "tab").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = posted.join(shared.withColumn("blocks", blocks), ["key", "tab"]).withColumn("own", own)
    work = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select(
        "rep", "tab", "guest", (F.col("own") != F.col("other")).alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        F.xxhash64("key", "tab", F.least("own", "other"), F.greatest("own", "other")).alias("work"),
    )
    work = scratch.save(work.join(distinct.select("rep", "vector", "weight"), "rep"))
    bins = max(1, -(-work.count() // BIN))
    found = scratch.save(work.withColumns({"bin": F.pmod("work", F.lit(bins)), "size": F.size("vector")}).groupBy("bin", "size").applyInPandas(_bin(lines), "rep long, links long, root long"))
    scratch.drop(work)
    scratch.drop(posted)

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    known = distinct.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = scratch.save(known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part")))
    joined = valid.drop("vector").join(known, key).select("vec_id", "n_links", F.col("part").alias("component_id"))
    alone = rows.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
