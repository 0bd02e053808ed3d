"""Bounded graph reasoning: a few hops of joins, each from a small frontier to the edges.

Every frontier is aggregated by node before the next join, so it never holds more rows than nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


ENDS = ("from_claim_id", "to_claim_id", "relation")


@dataclass(frozen=True)
class GraphConfig:
    """Fixed default weights; `clamped` brings overrides into their ranges."""

    max_hops: int = 3
    decay: float = 0.75
    supports: float = 1.0
    contradicts: float = -1.0
    refines: float = 0.55
    duplicates: float = 0.35
    depends_on: float = 0.2
    path_bonus: float = 0.16
    depth_penalty: float = 0.20

    @classmethod
    def clamped(cls, **given: float) -> GraphConfig:
        c = cls(**given)
        return cls(**{**c.__dict__, "max_hops": max(1, int(c.max_hops)), "decay": min(1.0, max(0.0, c.decay)), "path_bonus": max(0.0, c.path_bonus), "depth_penalty": max(0.0, c.depth_penalty)})

    def weight(self, relation: Column) -> Column:
        found = F.when(relation == "supports", self.supports)
        for name in ("contradicts", "refines", "duplicates", "depends_on"):
            found = found.when(relation == name, getattr(self, name))
        return found.otherwise(0.0)


def min_depths(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, depth): the fewest hops from the start nodes, up to `hops`."""
    seen = start.select(F.col("claim_id").alias("node")).distinct().withColumn("depth", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        reached = edges.join(front, F.col("from_claim_id") == F.col("node"), "left_semi").select(F.col("to_claim_id").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop))
        seen = seen.union(front)
    return seen


def traverse(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Each edge once whose source lies fewer than `hops` hops from the start, with that depth."""
    depths = min_depths(start, edges, hops - 1)
    return edges.join(depths, F.col("from_claim_id") == F.col("node")).drop("node").dropDuplicates(["edge_id"])


def incoming_weight(start: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    depths = min_depths(start, edges, config.max_hops - 1)
    gain = config.weight(F.col("relation")) * F.col("strength") * F.pow(F.lit(config.decay), F.col("depth"))
    return edges.select(*ENDS, "strength").join(depths, F.col("from_claim_id") == F.col("node")).groupBy(F.col("to_claim_id").alias("claim_id")).agg(F.sum(gain).alias("incoming"))


def support_paths(start: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Walks over supporting edges that end at a node, of no to `hops` steps."""
    front = start.select("claim_id").distinct().withColumn("paths", F.lit(1).cast("long"))
    every = front
    own = edges.filter(F.col("relation") == "supports").select("from_claim_id", "to_claim_id")
    for _ in range(hops):
        front = own.join(front, F.col("from_claim_id") == F.col("claim_id")).groupBy("to_claim_id").agg(F.sum("paths").alias("paths")).select(F.col("to_claim_id").alias("claim_id"), "paths")
        every = every.union(front)
    return every.groupBy("claim_id").agg(F.sum("paths").alias("paths"))


def contradiction_depth(start: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """The longest run of contradicting edges that a walk ends with."""
    front = start.select("claim_id").distinct().withColumn("depth", F.lit(0))
    every = front
    for _ in range(hops):
        step = F.when(F.col("relation") == "contradicts", F.col("depth") + 1).otherwise(0)
        front = edges.select(*ENDS).join(front, F.col("from_claim_id") == F.col("claim_id")).groupBy("to_claim_id").agg(F.max(step).alias("depth")).select(F.col("to_claim_id").alias("claim_id"), "depth")
        every = every.union(front)
    return every.groupBy("claim_id").agg(F.max("depth").alias("depth"))


def reasoning(start: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(claim_id, graph_score, support_path_count, contradiction_chain_depth) of the start and all ends of edges."""
    nodes = start.select("claim_id").union(edges.select("from_claim_id")).union(edges.select("to_claim_id")).distinct()
    out = nodes.join(incoming_weight(start, edges, config), "claim_id", "left").join(support_paths(start, edges, config.max_hops), "claim_id", "left")
    out = out.join(contradiction_depth(start, edges, config.max_hops), "claim_id", "left")
    paths, depth = F.coalesce("paths", F.lit(0)), F.coalesce("depth", F.lit(0))
    raw = F.coalesce("incoming", F.lit(0.0)) + F.log1p(paths) * config.path_bonus - F.pow(depth.cast("double"), F.lit(1.25)) * config.depth_penalty
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.tanh(raw) + 1) * 0.5))
    return out.select("claim_id", score.alias("graph_score"), paths.alias("support_path_count"), depth.cast("int").alias("contradiction_chain_depth"))


def evidence_graph(results: DataFrame, claims: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around results: neighbours that are claims of the tenant join with score 0; dangling edges stay listed."""
    walked = traverse(results, edges, config.max_hops)
    ends = walked.select(F.explode(F.array("from_claim_id", "to_claim_id")).alias("claim_id")).distinct()
    more = claims.join(ends, "claim_id", "left_semi").join(results, "claim_id", "left_anti").select("claim_id", F.lit(0.0).alias("score"))
    nodes = results.select("claim_id", "score").union(more).join(reasoning(results, walked, config), "claim_id")
    shown = walked.withColumn("relation", F.when(F.col("relation") == "depends_on", "dependson").otherwise(F.col("relation")))
    return nodes.orderBy("claim_id"), shown
