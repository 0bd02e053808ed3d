"""Tiered segments: build, compact, publish, visibility, and the checks of what was published."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schema as S
from ..functions.hashing import fnv1a_hex
from ..schema import IntegrityError
from ..sources.workspace import ranked
from .projection import tier

TIERS = ("hot", "warm", "cold")


def tier_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy(tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


def preview(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", tier(F.col("confidence")).alias("tier"))


def build(claims: DataFrame, size: int) -> DataFrame:
    """(tier, segment_id, claim_id): claims of a tier in order of claim_id, `size` to a segment.

    Ranks come from a range sort over the tier and id, so no tier is numbered in one task.
    """
    rows = ranked(preview(claims), "tier", "claim_id")
    first = rows.groupBy("tier").agg(F.min("_rank").alias("_first"))
    placed = rows.join(F.broadcast(first), "tier")  # a row per tier
    number = F.floor((F.col("_rank") - F.col("_first")) / size).cast("long")
    return placed.select("tier", F.concat_ws("-", "tier", number.cast("string")).alias("segment_id"), "claim_id")


def ordinal(segment_id: str = "segment_id"):
    """The number in a segment's id; merged ones come last."""
    return F.coalesce(F.regexp_extract(segment_id, "-([0-9]+)$", 1).try_cast("long"), F.lit(1 << 62))


def compact(segments: DataFrame, trigger: int = S.SEGMENT_TRIGGER, inputs: int = S.SEGMENT_INPUTS) -> DataFrame:
    """One round: a tier of more than `trigger` segments has its first `inputs` merged into one."""
    listed = segments.select("tier", "segment_id").distinct()
    order = Window.partitionBy("tier").orderBy(ordinal(), "segment_id")
    ranked = listed.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("tier"))})
    merged = (F.col("n") > trigger) & (F.col("at") <= inputs)
    plan = ranked.select("tier", "segment_id", F.when(merged, F.concat(F.col("tier"), F.lit("-merged"))).otherwise(F.col("segment_id")).alias("into"))
    return segments.join(plan, ["tier", "segment_id"]).select("tier", F.col("into").alias("segment_id"), "claim_id")


def manifest(segments: DataFrame) -> DataFrame:
    """One row per segment: its size, and a checksum over its ids that no order changes."""
    code = F.conv(F.substring(fnv1a_hex("claim_id"), 1, 15), 16, 10).cast("decimal(38,0)")
    return segments.groupBy("tier", "segment_id").agg(F.count("*").alias("n_claims"), F.sum(code).cast("string").alias("checksum"))


def visible(claims: DataFrame, base: DataFrame) -> DataFrame:
    """Base ids and what the tenant has beyond them, with where each came from."""
    delta = claims.select("claim_id").join(base, "claim_id", "left_anti").withColumn("origin", F.lit("delta"))
    return base.select("claim_id").distinct().withColumn("origin", F.lit("base")).union(delta)


def divergence(seen: DataFrame) -> DataFrame:
    """Sizes of base and delta, their ratio, and whether it calls for a warning."""
    counts = seen.agg(F.count_if(F.col("origin") == "base").alias("base"), F.count_if(F.col("origin") == "delta").alias("delta"))
    ratio = F.coalesce(F.col("delta") / F.nullif(F.col("base") + F.col("delta"), F.lit(0)), F.lit(0.0))
    warn = (F.col("delta") > 0) & ((F.col("delta") >= S.WARN_DELTA) | (ratio >= S.WARN_RATIO))
    return counts.select("base", "delta", ratio.alias("ratio"), warn.alias("warn"))


def provenance(results: DataFrame, seen: DataFrame) -> DataFrame:
    """How many results came from base and delta, and how many lie outside what is visible."""
    joined = results.select("claim_id").join(seen, "claim_id", "left")
    return joined.agg(F.count_if(F.col("origin") == "base").alias("from_base"), F.count_if(F.col("origin") == "delta").alias("from_delta"), F.count_if(F.col("origin").isNull()).alias("outside"))


class SegmentStore:
    """Segments as Parquet, a generation to a folder; a manifest row names the generation that counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        path, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def published(self) -> list[int]:
        path, fs = self._files()
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [g for g in self.generations() if fs.exists(make(f"{self.root}/generation={g}/manifest/_SUCCESS"))]

    def publish(self, segments: DataFrame) -> int:
        """Data first, the manifest last: a generation without one was never published."""
        at = max(self.generations(), default=0) + 1
        segments.write.partitionBy("tier").parquet(f"{self.root}/generation={at}/segments")
        manifest(self._data(at)).write.parquet(f"{self.root}/generation={at}/manifest")
        return at

    def _data(self, at: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generation={at}/segments")

    def load(self) -> DataFrame:
        """The newest published generation, held against its manifest."""
        found = self.published()
        if not found:
            raise IntegrityError("nothing was published")
        said = self.spark.read.parquet(f"{self.root}/generation={found[-1]}/manifest")
        have, keys = manifest(self._data(found[-1])), ["tier", "segment_id", "n_claims", "checksum"]
        wrong = have.select(keys).exceptAll(said.select(keys)).union(said.select(keys).exceptAll(have.select(keys)))
        if wrong.limit(1).count():
            raise IntegrityError("segments and manifest differ")
        return self._data(found[-1])

    def _age_seconds(self, generation: int) -> float:
        _, fs = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generation={generation}")
        return time.time() - fs.getFileStatus(path).getModificationTime() / 1000

    def prune(self, keep: int = 2, min_age_s: float = 0.0) -> list[int]:
        """Remove generations before the newest but the newest `keep` published ones and those younger than `min_age_s`, which a reader may still read."""
        published = self.published()
        kept = set(published[-keep:])
        gone = [g for g in self.generations() if g not in kept and published and g < published[-1] and self._age_seconds(g) >= min_age_s]
        _, fs = self._files()
        for g in gone:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generation={g}"), True)
        return gone


def maintain(spark: SparkSession, root: str, min_age_s: float, keep: int = 2) -> dict[str, list[int]]:
    """A sweep over the tenants below `root`, each a segment store: what was removed of each."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tenants = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
    return {t: SegmentStore(spark, f"{root.rstrip('/')}/{t}").prune(keep, min_age_s) for t in tenants}


class SegmentPrefilter:
    """The claim ids of a tenant's published segments, looked up again after `ttl_s`; why there are none is said in `reason`."""

    def __init__(self, store: SegmentStore, ttl_s: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.store, self.ttl_s, self.clock = store, ttl_s, clock
        self.read_at: float | None = None
        self.generation: int | None = None
        self.reason: str | None = None
        self.refreshes = 0

    def ids(self) -> DataFrame | None:
        """Claim ids, or None if all claims have to be read: nothing published, or segments that differ from their manifest."""
        if self.read_at is None or self.clock() - self.read_at >= self.ttl_s:
            self.read_at, self.refreshes = self.clock(), self.refreshes + 1
            try:
                self.store.load()
                self.generation, self.reason = self.store.published()[-1], None
            except IntegrityError as error:
                self.generation, self.reason = None, "missing_manifest" if "nothing" in str(error) else "invalid_segments"
        return None if self.generation is None else self.store._data(self.generation).select("claim_id").distinct()
