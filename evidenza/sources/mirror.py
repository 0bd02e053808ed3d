"""A mirror of the state as Parquet tables, one generation to a folder, with its high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import IntegrityError, Tables
from . import changelog

TABLES = ("claims", "evidence", "edges", "vectors")


class Mirror:
    """Written as a whole by `checkpoint`; its last table, `meta`, makes a generation count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _generations(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/meta/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and whole(n))

    def checkpoint(self, tables: Tables, high_water: int) -> int:
        """Each tenant's rows lie together, so a tenant's reads skip the files of others."""
        at = max(self._generations(), default=0) + 1
        for name in TABLES:
            rows = getattr(tables, name)
            (rows.repartitionByRange("tenant_id", "claim_id") if "tenant_id" in rows.columns else rows).write.mode("overwrite").parquet(f"{self.root}/{at}/{name}")
        counts = [getattr(self._load(at), n).count() for n in TABLES]
        self.spark.createDataFrame([(high_water, *counts)], "high_water long, " + ", ".join(f"{n} long" for n in TABLES)).write.mode("overwrite").parquet(f"{self.root}/{at}/meta")
        return at

    def _load(self, at: int) -> Tables:
        return Tables(*(self.spark.read.parquet(f"{self.root}/{at}/{n}") for n in TABLES))

    def newest(self) -> int:
        found = self._generations()
        if not found:
            raise IntegrityError("the mirror is empty")
        return found[-1]

    def load(self) -> Tables:
        return self._load(self.newest())

    def meta(self) -> dict[str, int]:
        return self.spark.read.parquet(f"{self.root}/{self.newest()}/meta").first().asDict()

    def claim(self, claim_id: str) -> DataFrame:
        return self.load().claims.filter(F.col("claim_id") == claim_id)

    def tenant_dimension(self) -> DataFrame:
        """(tenant_id, dimensions): one size of vectors for each tenant; more than one is an error to repair."""
        t = self.load()
        sizes = t.vectors.join(t.claims.select("claim_id", "tenant_id"), "claim_id").select("tenant_id", F.size("values").alias("size"))
        return sizes.groupBy("tenant_id").agg(F.max("size").alias("dimensions"), (F.min("size") != F.max("size")).alias("mixed"))


def cold_start(mirror: Mirror, log: DataFrame) -> Tables:
    """The mirror's state and what the log has beyond its high-water mark; nothing is applied twice."""
    base, mark = mirror.load(), mirror.meta()["high_water"]
    records = changelog.decode(log.filter(F.col("offset") >= mark))
    fresh, more = changelog.claims(records).drop("offset"), changelog.vectors(records)
    changed = fresh.select("claim_id")
    kept = base.vectors.join(changed, "claim_id", "left_anti").join(more.select("claim_id"), "claim_id", "left_anti")
    late = records.filter("kind = 'vector'").select(F.col("f")[1].alias("claim_id"), "offset", F.col("f")[2].alias("raw")).join(changed, "claim_id", "left_anti")
    late = late.groupBy("claim_id").agg(F.max_by("raw", "offset").alias("raw")).select("claim_id", F.transform(F.split("raw", ","), lambda x: x.cast("float")).alias("values"))
    vectors = kept.join(late.select("claim_id"), "claim_id", "left_anti").union(more).union(late)
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return Tables(both(base.claims.join(changed, "claim_id", "left_anti"), fresh), both(base.evidence, changelog.evidence(records)), both(base.edges, changelog.edges(records)), vectors)
