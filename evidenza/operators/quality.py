"""Measures of results and of the service: recall, F1, coverage, quantiles, audit chains, index statistics."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import index_key, tokenize
from ..schema import Tables
from ..sources.workspace import ranked


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact results, those found, and their share (1 where nothing was to be found)."""
    hits = exact.select("claim_id").join(found.select("claim_id").distinct().withColumn("hit", F.lit(1)), "claim_id", "left")
    counts = hits.agg(F.count("*").alias("exact"), F.count("hit").alias("hits"))
    return counts.withColumn("recall", F.coalesce(F.col("hits") / F.nullif("exact", F.lit(0)), F.lit(1.0)))


def f1(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    both = predicted.select("claim_id").distinct().withColumn("p", F.lit(1)).join(actual.select("claim_id").distinct().withColumn("a", F.lit(1)), "claim_id", "full")
    counts = both.agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return counts.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def contradicted(signals: DataFrame) -> DataFrame:
    return signals.filter("contradicts > supports").select("claim_id")


def coverage(rows: DataFrame, covered: Column) -> DataFrame:
    counts = rows.agg(F.count("*").alias("n"), F.count_if(covered).alias("covered"))
    return counts.withColumn("coverage", F.coalesce(F.col("covered") / F.nullif("n", F.lit(0)), F.lit(0.0)))


def span_coverage(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of results (claim_id) the share with evidence that names its document and the span in it."""
    spanned = evidence.filter("doc_id is not null and span_start is not null and span_end is not null").select("claim_id").distinct().withColumn("spanned", F.lit(True))
    return coverage(results.select("claim_id").join(spanned, "claim_id", "left"), F.col("spanned").isNotNull())


def graph_coverage(nodes: DataFrame) -> DataFrame:
    return nodes.agg((F.count("graph_score") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"), F.max("support_path_count").alias("most_paths"), F.max("contradiction_chain_depth").alias("deepest"))


def nearest_rank(values: DataFrame, column: str, q: float) -> DataFrame:
    """The sample at place round((n - 1) q) of the sorted samples, without gathering them."""
    rows = ranked(values.select(column).filter(F.col(column).isNotNull()), column)
    want = rows.agg(F.round((F.count("*") - 1) * q).cast("long").alias("_want"))
    return rows.crossJoin(F.broadcast(want)).filter("_rank = _want").select(F.col(column).alias("value"))  # one row


#: Rows of a key whose windows one task slides over, besides the window before them.
SLIDE = 1 << 16


def sliding_quantile(values: DataFrame, column: str, order: str, key: str, q: float, width: int = 2048) -> DataFrame:
    """Nearest rank over the last `width` samples of each key; null samples are none.

    A key's rows are cut into stretches of SLIDE, each with the `width` - 1 rows before it, so a hot key is no one
    task's; the sorted window is kept up to date row by row.
    """
    rows = ranked(values, key, order)
    first = rows.groupBy(key).agg(F.min("_rank").alias("_first")).withColumnRenamed(key, "_key")
    at = rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_at", F.col("_rank") - F.col("_first")).drop("_rank", "_first")
    own = F.floor(F.col("_at") / SLIDE)
    late = (F.floor((F.col("_at") + width - 1) / SLIDE)).cast("long")
    dealt = at.withColumn("_cut", F.explode(F.sequence(own.cast("long"), late)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema) + ", quantile double"

    names, slide = [*values.columns, "quantile"], SLIDE

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at", kind="stable")
        cut, places, samples = int(part["_cut"].iloc[0]), part["_at"].to_numpy(), part[column].to_numpy("float64")
        held: list[float] = []
        out = np.full(len(part), np.nan)
        for i, x in enumerate(samples):
            if i >= width and not math.isnan(old := samples[i - width]):
                held.pop(bisect.bisect_left(held, old))
            if not math.isnan(x):
                bisect.insort(held, x)
            if held:
                out[i] = held[int((len(held) - 1) * q + 0.5)]
        mine = places >= cut * slide
        return part.assign(quantile=pd.Series(out, part.index).astype(object).where(~np.isnan(out), None))[mine][names]

    return dealt.groupBy("_key", "_cut").applyInPandas(run, schema)


def visible_lag_ms(claims: DataFrame, now: int) -> DataFrame:
    past = F.col("event_time_unix") <= now
    return claims.agg(F.avg(F.when(past, (F.lit(now) - F.col("event_time_unix")) * 1000)).alias("lag_ms"))


def chain(events: DataFrame, order: str, payload: Column, key: str) -> DataFrame:
    """Hash-chained audit rows of each key: seq, prev_hash, hash.

    A hash covers all before it, so a key's chain is one task's, which streams over its rows in their order; memory
    does not follow the chain's length.
    """
    rows = events.select(key, F.col(order).alias("_order"), payload.alias("payload")).repartition(key).sortWithinPartitions(key, "_order", "payload")
    schema = f"`{key}` {dict(events.dtypes)[key]}, seq long, payload string, prev_hash string, hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, last = object(), 0, "0" * 64
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch["payload"], strict=True):
                if k != now:
                    now, seq, last = k, 0, "0" * 64
                before, seq = last, seq + 1
                last = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
                out.append((k, seq, text, before, last))
            yield pd.DataFrame(out, columns=[key, "seq", "payload", "prev_hash", "hash"])

    return rows.drop("_order").mapInPandas(run, schema)


def verify_chain(rows: DataFrame, key: str) -> DataFrame:
    """Of each row what is wrong first: its number, its link to the row before, or its own hash; null if nothing is."""
    w = Window.partitionBy(key).orderBy("seq")
    before, last = F.lag("hash").over(w), F.lag("seq").over(w)
    own = F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256)
    seen = rows.withColumns({"_before": before, "_last": last})
    fault = (
        F.when(F.coalesce(F.col("seq") != F.col("_last") + 1, F.col("seq") < 1), "seq")
        .when(F.col("_before").isNotNull() & (F.lower("prev_hash") != F.lower("_before")), "prev_hash")
        .when(F.lower("hash") != own, "hash")
    )
    return seen.withColumn("fault", fault).drop("_before", "_last")


def index_stats(tables: Tables) -> DataFrame:
    """One row per tenant: claims, distinct tokens, entities, embedding ids, event times, vectors.

    Claims are read once: each gives the distinct values it holds, which are made distinct over all before they are counted.
    """
    claims = tables.claims.select("claim_id", "tenant_id", "event_time_unix", "entities", "embedding_ids", tokenize(F.col("canonical_text")).alias("tokens"))
    kinds = {"terms": F.array_distinct("tokens"), "entities": F.array_distinct(F.transform("entities", index_key)), "embedding_ids": F.array_distinct("embedding_ids")}
    tagged = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    one = F.array(F.struct(F.lit("claims").alias("kind"), F.lit(None).cast("string").alias("x")))
    time = F.when(F.col("event_time_unix").isNotNull(), F.array(F.struct(F.lit("event_times").alias("kind"), F.lit(None).cast("string").alias("x")))).otherwise(F.array().cast("array<struct<kind:string,x:string>>"))
    empty = F.array().cast("array<struct<kind:string,x:string>>")
    values = claims.select("tenant_id", F.explode(F.concat(one, time, *(F.coalesce(tagged(k, v), empty) for k, v in kinds.items()))).alias("v"))
    distinct = values.groupBy("tenant_id", "v.kind", "v.x").agg(F.count("*").alias("n"))
    counted = distinct.groupBy("tenant_id").agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("claims", "event_times")),
        *(F.count_if((F.col("kind") == k) & F.col("x").isNotNull()).alias(k) for k in kinds),
    )
    vectors = tables.vectors.select("claim_id").join(tables.claims.select("claim_id", "tenant_id"), "claim_id").groupBy("tenant_id").agg(F.count("*").alias("vectors"))
    return counted.join(vectors, "tenant_id", "left").na.fill(0, ["vectors"])
