"""Ingest requests as JSON: claims with evidence, edges and a vector, parsed and checked in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import valid
from ..schema import CLAIM_TYPES, RELATIONS, STANCES, StoreError

_EVIDENCE = "array<struct<evidence_id:string,claim_id:string,source_id:string,stance:string,source_quality:double,chunk_id:string,span_start:bigint,span_end:bigint,doc_id:string,extraction_model:string,ingested_at:bigint>>"
_EDGES = "array<struct<edge_id:string,from_claim_id:string,to_claim_id:string,relation:string,strength:double,reason_codes:array<string>,created_at:bigint>>"
_CLAIM = "struct<claim_id:string,tenant_id:string,canonical_text:string,confidence:double,event_time_unix:bigint,entities:array<string>,embedding_ids:array<string>,embedding_vector:array<float>,claim_type:string,valid_from:bigint,valid_to:bigint,created_at:bigint,updated_at:bigint>"
REQUEST = f"claim {_CLAIM}, claim_embedding array<float>, evidence {_EVIDENCE}, edges {_EDGES}"


def _outside(values: Column, field: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(values, lambda x: ~F.coalesce(x[field].isin(*allowed), F.lit(False))), F.lit(False))


def parse(requests: DataFrame, body: str = "body") -> DataFrame:
    """The request's parts, and in `error` what is wrong first. A vector beside the claim counts before one inside it."""
    r = requests.withColumn("r", F.from_json(body, REQUEST))
    kind, vector = F.lower(F.trim("r.claim.claim_type")), F.col("r.claim.embedding_vector")
    error = (
        F.when(F.col("r.claim").isNull(), "body")
        .when(kind.isNotNull() & ~kind.isin(*CLAIM_TYPES), "claim_type")
        .when(vector.isNotNull() & ~valid(vector), "embedding_vector")
        .when(_outside(F.col("r.evidence"), "stance", STANCES), "stance")
        .when(_outside(F.col("r.edges"), "relation", RELATIONS), "relation")
        .when(F.coalesce(F.exists("r.evidence", lambda e: e["claim_id"] != F.col("r.claim.claim_id")), F.lit(False)), "evidence_claim")
        .when(F.coalesce(F.exists("r.edges", lambda e: e["from_claim_id"] != F.col("r.claim.claim_id")), F.lit(False)), "edge_claim")
    )
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    claim = F.struct(*(F.col(f"r.claim.{c}").alias(c) for c in ("claim_id", "tenant_id", "canonical_text", "confidence", "event_time_unix")), none("r.claim.entities", "array<string>").alias("entities"), none("r.claim.embedding_ids", "array<string>").alias("embedding_ids"), kind.alias("claim_type"), *(F.col(f"r.claim.{c}").alias(c) for c in ("valid_from", "valid_to", "created_at", "updated_at")))
    kept = [c for c in requests.columns if c not in (body, "claim", "vector", "evidence", "edges", "error")]
    return r.select(*kept, claim.alias("claim"), F.coalesce("r.claim_embedding", "r.claim.embedding_vector").alias("vector"), none("r.evidence", _EVIDENCE).alias("evidence"), none("r.edges", _EDGES).alias("edges"), error.alias("error"))


def check_batch(parsed: DataFrame, most: int = 128) -> None:
    """One batch: 1 to `most` items, of one tenant, none of them wrong."""
    facts = parsed.agg(F.count("*").alias("n"), F.count_distinct("claim.tenant_id").alias("tenants"), F.min("error").alias("error")).first()
    if not 1 <= facts["n"] <= most:
        raise StoreError(f"a batch needs 1 to {most} items")
    if facts["tenants"] > 1:
        raise StoreError("a batch has one tenant")
    if facts["error"]:
        raise StoreError(f"wrong {facts['error']}")
