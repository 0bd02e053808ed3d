"""The driver's tables as claims, evidence, edges and vectors, and the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in fewer splits than there are cores, such as one small file, are dealt to all; larger ones stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _claim_id(number):
    return F.concat(F.lit("doc-"), F.lpad(number.cast("string"), 8, "0"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    start = F.lit(1704067200) + d * 1800
    return documents(spark, sf_dir).select(
        _claim_id(d).alias("claim_id"),
        F.col("lang").alias("tenant_id"),
        F.col("text").alias("canonical_text"),
        ((d * 37 % 101) / F.lit(100.0)).alias("confidence"),
        F.when(d % 3 != 0, F.lit(1704067200) + d * 3600).alias("event_time_unix"),
        F.array("source").alias("entities"),
        F.array(F.concat(F.lit("emb-"), (d % 50).cast("string"))).alias("embedding_ids"),
        F.when(d % 4 != 0, start).alias("valid_from"),
        F.when(d % 5 != 0, start + 604800).alias("valid_to"),
    )


def load(spark: SparkSession, sf_dir: str) -> Tables:
    n = table(spark, sf_dir, "documents").count()
    e, o = F.col("event_id"), F.col("o_orderkey")
    stance = F.when(F.col("event_type").isin("purchase", "signup"), "supports").when(F.col("event_type") == "error", "contradicts").otherwise("neutral")
    evidence = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), e.cast("string")).alias("evidence_id"),
        _claim_id(e * 7 % n).alias("claim_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"),
        stance.alias("stance"),
        ((e * 13 % 101) / F.lit(100.0)).alias("source_quality"),
        e.alias("seq"),
    )
    relation = F.element_at(F.array(*map(F.lit, ("supports", "contradicts", "refines", "duplicates", "depends_on"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    edges = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord-"), o.cast("string")).alias("edge_id"),
        _claim_id(F.col("o_custkey") % n).alias("from_claim_id"),
        _claim_id(o * 11 % n).alias("to_claim_id"),
        relation.alias("relation"),
        ((o % 101) / F.lit(100.0)).alias("strength"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(_claim_id(F.col("vec_id")).alias("claim_id"), F.col("embedding").alias("values"))
    return Tables(claims(spark, sf_dir), evidence, edges, vectors)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_ID = "'doc-' || lpad(CAST({} AS VARCHAR), 8, '0')"

#: The same tables for DuckDB: a WITH clause to put before a query.
SQL = f"""
WITH size AS (SELECT count(*) AS n FROM documents),
claims AS (
  SELECT doc_id, {_ID.format("doc_id")} AS claim_id, lang AS tenant_id, text AS canonical_text,
    CAST((doc_id * 37 % 101) / 100.0 AS DOUBLE) AS confidence,
    CASE WHEN doc_id % 3 <> 0 THEN 1704067200 + doc_id * 3600 END AS event_time_unix,
    source AS entity, 'emb-' || CAST(doc_id % 50 AS VARCHAR) AS embedding_id,
    CASE WHEN doc_id % 4 <> 0 THEN 1704067200 + doc_id * 1800 END AS valid_from,
    CASE WHEN doc_id % 5 <> 0 THEN 1704067200 + doc_id * 1800 + 604800 END AS valid_to
  FROM documents),
evidence AS (
  SELECT event_id, 'ev-' || CAST(event_id AS VARCHAR) AS evidence_id, {_ID.format("event_id * 7 % n")} AS claim_id,
    'user-' || CAST(user_id AS VARCHAR) AS source_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'supports' WHEN event_type = 'error' THEN 'contradicts' ELSE 'neutral' END AS stance,
    CAST((event_id * 13 % 101) / 100.0 AS DOUBLE) AS source_quality
  FROM events, size),
edges AS (
  SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) AS edge_id, {_ID.format("o_custkey % n")} AS from_claim_id, {_ID.format("o_orderkey * 11 % n")} AS to_claim_id,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'supports' WHEN '2' THEN 'contradicts' WHEN '3' THEN 'refines' WHEN '4' THEN 'duplicates' ELSE 'depends_on' END AS relation,
    CAST((o_orderkey % 101) / 100.0 AS DOUBLE) AS strength
  FROM orders, size),
vectors AS (
  SELECT {_ID.format("vec_id")} AS claim_id, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
tokens AS (
  SELECT claim_id, tenant_id, list_filter(list_transform(string_split_regex(canonical_text, '\\s+'), lambda t: lower(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '') AS toks
  FROM claims)
"""
