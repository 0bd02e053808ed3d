"""Record types, allowed values and constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

STANCES = ("supports", "contradicts", "neutral")
RELATIONS = ("supports", "contradicts", "refines", "duplicates", "depends_on")
CLAIM_TYPES = ("factual", "opinion", "prediction", "temporal", "causal")
STANCE_MODES = ("balanced", "support_only")

# Fixed values of the scoring formulas.
BM25_K1, BM25_B = 1.2, 0.75
WEIGHT_OVERLAP, WEIGHT_SUPPORT, WEIGHT_CONTRADICT, WEIGHT_QUALITY, WEIGHT_CONFIDENCE = 0.6, 0.08, 0.10, 0.15, 0.25
BLEND_BASE, BLEND_BM25, SEMANTIC_LEXICAL = 0.72, 0.28, 0.1
# Fixed values of tiers, bands, segments and warnings.
TIER_HOT, TIER_WARM = 0.85, 0.6
BAND_HIGH, BAND_MEDIUM = 0.8, 0.5
SEGMENT_TRIGGER, SEGMENT_INPUTS = 8, 4
WARN_DELTA, WARN_RATIO = 1000, 0.25

CLAIM = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("canonical_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("event_time_unix", T.LongType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("embedding_ids", T.ArrayType(T.StringType())),
        T.StructField("claim_type", T.StringType()),
        T.StructField("valid_from", T.LongType()),
        T.StructField("valid_to", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
EVIDENCE = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),
        T.StructField("claim_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("stance", T.StringType()),
        T.StructField("source_quality", T.DoubleType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("extraction_model", T.StringType()),
        T.StructField("ingested_at", T.LongType()),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("from_claim_id", T.StringType()),
        T.StructField("to_claim_id", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Tables:
    """The four tables every retrieval plan reads."""

    claims: DataFrame
    evidence: DataFrame
    edges: DataFrame
    vectors: DataFrame


class StoreError(ValueError):
    """A request that the store refuses; `status` is the code a service would answer with."""

    status = 400


class ConflictError(StoreError):
    status = 409


class IntegrityError(StoreError):
    status = 500
