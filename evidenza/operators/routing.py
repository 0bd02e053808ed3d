"""Shard routing, placements, read and write routes, acknowledgements, access decisions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import ROUTING_BASIS, fnv1a
from ..schema import ConflictError, StoreError
from .projection import write_key

ROLES, HEALTH = ("leader", "follower"), ("healthy", "degraded", "unavailable")
PLACEMENT = "tenant_id string, shard_id long, epoch long, node_id string, role string, health string"
VIRTUAL_NODES = 64


def _joined(a: pd.Series, b: pd.Series, between: str) -> list[bytes]:
    return [f"{x}{between}{y}".encode() for x, y in zip(a, b, strict=True)]


def shard_by_modulo(tenant: Column, key: Column, shards: int) -> Column:
    @F.pandas_udf("long")
    def route(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series((fnv1a(_joined(t, k, ""), ROUTING_BASIS) % np.uint64(max(1, shards))).astype("int64"))

    return route(tenant, key)


def ring(shards: list[int], virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in order, and their shards; of equal positions the later shard stays."""
    at = {int(fnv1a([f"shard:{s}:vn:{v}".encode()], ROUTING_BASIS)[0]): s for s in shards or [0] for v in range(max(1, virtual_nodes))}
    order = sorted(at)
    return np.array(order, "u8"), np.array([at[x] for x in order], "int64")


def shards_by_ring(tenant: Column, key: Column, shards: list[int], replicas: int = 1, virtual_nodes: int = VIRTUAL_NODES) -> Column:
    """The shard at or after the key's hash, then the next ones around the ring that differ from it and from their neighbour."""
    positions, owners = ring(shards, virtual_nodes)

    @F.pandas_udf("array<long>")
    def route(t: pd.Series, k: pd.Series) -> pd.Series:
        first = np.searchsorted(positions, fnv1a(_joined(t, k, "|"), ROUTING_BASIS)) % len(positions)
        around = {}
        for at in np.unique(first):
            turn = np.concatenate([owners[at:], owners[:at]])
            turn = turn[np.concatenate([[True], turn[1:] != turn[:-1]])]
            around[at] = [int(turn[0]), *(int(s) for s in turn[1:] if s != turn[0])][:max(1, replicas)]
        return pd.Series([around[at] for at in first], dtype=object)

    return route(tenant, key)


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """Placement rows of a CSV file; raises on wrong columns, mixed epochs of a shard, or a node listed twice."""
    return parse_placements(spark.read.text(path))


def parse_placements(values: DataFrame) -> DataFrame:
    """The same for lines (value); blank lines and comments are passed over."""
    lines = values.select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    cut = F.split("line", ",", -1)
    parts = lines.select("line", F.size(cut).alias("n"), F.transform(cut, lambda c: F.trim(c)).alias("c"))
    rows = parts.select(
        "line", "n", F.get("c", F.lit(0)).alias("tenant_id"), F.get("c", F.lit(1)).try_cast("long").alias("shard_id"), F.get("c", F.lit(2)).try_cast("long").alias("epoch"),
        F.get("c", F.lit(3)).alias("node_id"), F.lower(F.get("c", F.lit(4))).alias("role"), F.lower(F.get("c", F.lit(5))).alias("health"),
    )
    bad = (F.col("n") != 6) | (F.col("tenant_id") == "") | (F.col("node_id") == "") | F.col("shard_id").isNull() | F.col("epoch").isNull() | ~F.col("role").isin(*ROLES) | ~F.col("health").isin(*HEALTH)
    wrong = rows.filter(F.coalesce(bad, F.lit(True))).select("line").first()
    if wrong:
        raise StoreError(f"invalid placement line: {wrong['line']}")
    out = rows.drop("line", "n")
    check_placements(out)
    return out


def check_placements(placements: DataFrame) -> None:
    shard = placements.groupBy("tenant_id", "shard_id").agg(F.count_distinct("epoch").alias("epochs"), F.count("*").alias("n"), F.count_distinct("node_id").alias("nodes"))
    wrong = shard.filter("epochs > 1 or n > nodes").first()
    if wrong:
        raise StoreError(f"placement of {wrong['tenant_id']}/{wrong['shard_id']}: " + ("epochs differ" if wrong["epochs"] > 1 else "a node is listed twice"))


def placement_lines(placements: DataFrame) -> DataFrame:
    return placements.orderBy("tenant_id", "shard_id", "node_id").select(F.concat_ws(",", "tenant_id", F.col("shard_id").cast("string"), F.col("epoch").cast("string"), "node_id", "role", "health").alias("value"))


def placements_from(spark: SparkSession, path: str | None, control_plane: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Placements of the control plane where there is one, else of the file."""
    if control_plane is not None:
        found = control_plane()
        check_placements(found)
        return found
    if not path:
        raise StoreError("placements need a control plane or a file")
    return read_placements(spark, path)


def claim_placements(claims: DataFrame, placements: DataFrame, shards: list[int], replicas: int = 1) -> DataFrame:
    """Every placement of the shard that each claim (tenant_id, entities, claim_id) is written to."""
    routed = claims.withColumn("key", write_key(F.col("entities"), F.col("claim_id")))
    routed = routed.withColumn("shard_id", F.get(shards_by_ring(F.col("tenant_id"), F.col("key"), shards, replicas), F.lit(0)))
    return routed.join(placements, ["tenant_id", "shard_id"])


def local_writes(claims: DataFrame, placements: DataFrame, shards: list[int], node: str, policy: str = "one") -> DataFrame:
    """(claim_id, shard_id, outcome): may this node write the claim?

    No leader is healthy, too few replicas are healthy for the policy (degraded ones do not count), or another node leads.
    """
    state = placements.groupBy("tenant_id", "shard_id").agg(
        F.count("*").alias("replicas"), F.count_if(F.col("health") == "healthy").alias("healthy"), F.max_by(F.when((F.col("role") == "leader") & (F.col("health") == "healthy"), F.col("node_id")), F.when((F.col("role") == "leader") & (F.col("health") == "healthy"), 1)).alias("leader")
    )
    routed = claims.withColumn("shard_id", F.get(shards_by_ring(F.col("tenant_id"), write_key(F.col("entities"), F.col("claim_id")), shards), F.lit(0)))
    outcome = F.when(F.col("replicas").isNull(), "no_placement").when(F.col("leader").isNull(), "no_leader").when(F.col("healthy") < required(F.lit(policy), F.col("replicas")), "too_few_replicas").when(F.col("leader") != node, "not_leader").otherwise("accepted")
    return routed.join(state, ["tenant_id", "shard_id"], "left").select("claim_id", "shard_id", outcome.alias("outcome"))


def shard_ids(placements: DataFrame) -> DataFrame:
    return placements.select("shard_id").distinct().orderBy("shard_id")


def readable() -> Column:
    return F.col("health").isin("healthy", "degraded")


def write_routes(placements: DataFrame) -> DataFrame:
    """The healthy leader of each shard; a shard without one has no row."""
    order = Window.partitionBy("tenant_id", "shard_id").orderBy("position")
    leaders = placements.filter((F.col("role") == "leader") & (F.col("health") == "healthy"))
    return leaders.withColumn("r", F.row_number().over(order)).filter("r = 1").select("tenant_id", "shard_id", "epoch", "node_id", "role")


def read_routes(placements: DataFrame, preference: str = "any_healthy") -> DataFrame:
    """One readable replica of each shard by preference, the first listed of equals."""
    rank = {
        "leader_only": F.when(F.col("role") == "leader", 0),
        "prefer_follower": F.when(F.col("role") == "follower", 0).otherwise(1),
        "any_healthy": F.lit(0),
    }[preference]
    order = Window.partitionBy("tenant_id", "shard_id").orderBy("rank", "position")
    found = placements.filter(readable()).withColumn("rank", rank).filter("rank is not null")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").select("tenant_id", "shard_id", "epoch", "node_id", "role")


def set_health(placements: DataFrame, node: str, health: str) -> DataFrame:
    return placements.withColumn("health", F.when(F.col("node_id") == node, health).otherwise(F.col("health")))


def promote(placements: DataFrame, node: str) -> DataFrame:
    """Make the node leader of its shards where it is readable: epoch + 1, the old leader follows; no change where it leads."""
    shard = Window.partitionBy("tenant_id", "shard_id")
    takes = F.max((F.col("node_id") == node) & (F.col("role") != "leader") & readable()).over(shard)
    new_role = F.when(~F.col("takes"), F.col("role")).when(F.col("node_id") == node, "leader").when(F.col("role") == "leader", "follower").otherwise(F.col("role"))
    out = placements.withColumn("takes", takes).withColumns({"role": new_role, "epoch": F.col("epoch") + F.col("takes").cast("long")})
    return out.drop("takes")


def replace_monotonic(current: DataFrame, candidate: DataFrame, expected_epoch: int | None = None) -> DataFrame:
    """The candidate, if no shard's epoch goes back or is missing, and the newest epoch is the one expected."""
    if expected_epoch is not None and (current.agg(F.max("epoch")).first()[0] or 0) != expected_epoch:
        raise ConflictError("the placement has another epoch")
    keys = ["tenant_id", "shard_id"]
    now, then = (p.groupBy(*keys).agg(F.max("epoch").alias(name)) for p, name in ((current, "now"), (candidate, "later")))
    if now.join(then, keys, "left").filter("later is null or later < now").limit(1).count():
        raise ConflictError("an epoch would go back")
    return candidate


def required(policy: Column, replicas: Column) -> Column:
    """One, a majority, or all."""
    return F.when(policy == "one", F.lit(1).cast("long")).when(policy == "quorum", F.floor(replicas / 2) + 1).otherwise(replicas)


def consistency(placements: DataFrame, policy: str, write: bool = False) -> DataFrame:
    """Of each shard: usable replicas (healthy for writes, readable for reads), those required, and whether that is met."""
    usable = F.count_if(F.col("health") == "healthy" if write else readable())
    counted = placements.groupBy("tenant_id", "shard_id").agg(F.count("*").alias("replicas"), usable.alias("usable"))
    need = required(F.lit(policy), F.col("replicas"))
    return counted.select("tenant_id", "shard_id", "usable", need.alias("required"), (F.col("usable") >= need).alias("met"))


def commit_status(acks: DataFrame) -> DataFrame:
    """Of acknowledgements (commit_id, replica_id, replicas, policy): distinct ones against those required."""
    counted = acks.groupBy("commit_id").agg(F.count_distinct("replica_id").alias("acks"), F.max(required(F.col("policy"), F.col("replicas"))).alias("required"))
    return counted.withColumn("status", F.when(F.col("acks") >= F.col("required"), "quorum_met").otherwise("pending"))


def write_summary(routes: DataFrame) -> DataFrame:
    return routes.agg(F.max("epoch").alias("epoch"), F.min("acks").alias("acks"), F.max("required").alias("required"))


def access_decision(key: Column, tenant: Column, revoked: list[str], scopes: dict[str, list[str]], required_keys: list[str], tenants: list[str]) -> Column:
    """Revoked first, then a scoped key's tenants, then required keys, then the list of tenants (`*`: all)."""
    allowed = lambda listed: F.lit("*" in listed) | tenant.isin(*listed) if listed else F.lit(True)
    out = F.when(key.isin(*revoked) if revoked else F.lit(False), "revoked")
    for k, listed in scopes.items():
        out = out.when(key == k, F.when(allowed(listed), "allowed").otherwise("forbidden"))
    if required_keys:
        out = out.when(~F.coalesce(key.isin(*required_keys), F.lit(False)), "unauthorized")
    return out.when(~allowed(tenants), "forbidden").otherwise("allowed")


def drop_revoked(rows: DataFrame, revoked: DataFrame) -> DataFrame:
    return rows.join(revoked.select("key"), "key", "left_anti")
