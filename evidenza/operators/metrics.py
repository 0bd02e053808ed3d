"""Service metrics as rows, and as the text that scrapers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import Tables
from .projection import tier
from .quality import index_stats


def health(tables: Tables) -> DataFrame:
    """(name, tenant_id, value): index statistics and tier counts."""
    stats = index_stats(tables)
    names = [c for c in stats.columns if c != "tenant_id"]
    rows = stats.select("tenant_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("double") for c in names)))).alias("name", "value"))
    tiers = tables.claims.groupBy("tenant_id", F.concat(F.lit("tier_"), tier(F.col("confidence"))).alias("name")).agg(F.count("*").cast("double").alias("value"))
    return rows.select("name", "tenant_id", "value").union(tiers.select("name", "tenant_id", "value"))


def exposition(rows: DataFrame, prefix: str = "evidenza_") -> DataFrame:
    """One text line per metric row, in order."""
    return rows.orderBy("name", "tenant_id").select(F.format_string(f'{prefix}%s{{tenant="%s"}} %s', "name", "tenant_id", F.col("value").cast("string")).alias("line"))
