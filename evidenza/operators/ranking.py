"""Scores of claims for a query, as column expressions inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.text import count_token, count_tokens, has_token, padded


def overlap(pad: Column, query: list[str]) -> Column:
    """Share of the query's tokens, repeats counted, that the padded text holds."""
    if not query:
        return F.lit(0.0)
    return sum((has_token(pad, t).cast("double") for t in query[1:]), has_token(pad, query[0]).cast("double")) / len(query)


def has_any(pad: Column, query: list[str]) -> Column:
    found = F.lit(False)
    for t in dict.fromkeys(query):
        found = found | has_token(pad, t)
    return found


def corpus_stats(texts: DataFrame, query: list[str]) -> DataFrame:
    """One row for a tenant's texts (pad, n_tokens): n_docs, avg_len (1 at least), df_i of the i-th distinct query token, n_matched."""
    terms = list(dict.fromkeys(query))
    return texts.agg(
        F.count("*").alias("n_docs"),
        F.greatest(F.coalesce(F.avg(F.col("n_tokens").cast("double")), F.lit(0.0)), F.lit(1.0)).alias("avg_len"),
        *(F.count_if(has_token(F.col("pad"), t)).alias(f"df_{i}") for i, t in enumerate(terms)),
        F.count_if(has_any(F.col("pad"), terms)).alias("n_matched"),
    )


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(query: list[str]) -> Column:
    """Needs pad, n_tokens and the columns of corpus_stats; a repeated query token counts each time."""
    terms = list(dict.fromkeys(query))
    length = F.col("n_tokens").cast("double")
    norm = S.BM25_K1 * ((1 - S.BM25_B) + S.BM25_B * length / F.col("avg_len"))
    total = F.lit(0.0)
    for t in terms:
        tf = count_token(F.col("pad"), t).cast("double")
        total = total + query.count(t) * idf(F.col("n_docs"), F.col(f"df_{terms.index(t)}")) * (tf * (S.BM25_K1 + 1)) / (tf + norm)
    return F.when(length > 0, F.greatest(total, F.lit(0.0))).otherwise(0.0)


def base_score(over: Column, supports: Column, contradicts: Column, quality: Column, confidence: Column) -> Column:
    return S.WEIGHT_OVERLAP * over + S.WEIGHT_SUPPORT * supports - S.WEIGHT_CONTRADICT * contradicts + S.WEIGHT_QUALITY * quality + S.WEIGHT_CONFIDENCE * confidence


def lexical_score(base: Column, bm25_score: Column) -> Column:
    return S.BLEND_BASE * base + S.BLEND_BM25 * bm25_score


def semantic_score(cos: Column, lexical: Column) -> Column:
    return (F.coalesce(cos, F.lit(0.0)) + 1) * 0.5 + S.SEMANTIC_LEXICAL * lexical


def with_tokens(claims: DataFrame) -> DataFrame:
    """Claims with pad and n_tokens of their text."""
    return claims.withColumn("pad", padded(F.col("canonical_text"))).withColumn("n_tokens", count_tokens(F.col("pad")))


def stance_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(F.col(value) == "supports").alias("supports"), F.count_if(F.col(value) == "contradicts").alias("contradicts"))


def signals(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, supports, contradicts, quality): evidence and outgoing edges are aggregated before they meet."""
    own = evidence.groupBy("claim_id").agg(
        F.count_if(F.col("stance") == "supports").alias("s1"), F.count_if(F.col("stance") == "contradicts").alias("c1"), F.avg("source_quality").alias("quality")
    )
    out = stance_counts(edges, "from_claim_id", "relation").select(F.col("from_claim_id").alias("claim_id"), F.col("supports").alias("s2"), F.col("contradicts").alias("c2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(out, "claim_id", "full").select("claim_id", (zero("s1") + zero("s2")).alias("supports"), (zero("c1") + zero("c2")).alias("contradicts"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


def edge_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_claim_id").agg(
        *(F.count_if(F.col("relation") == r).alias(r) for r in S.RELATIONS), F.sum("strength").alias("strength"), F.count("*").alias("n_edges")
    )
