"""Headline queries, timed one after another; prints one JSON line."""

from __future__ import annotations

import json
import os
import time


def batch_1000(spark, sf_dir):
    """1,000 queries of five words each, dealt over the tenants, in one plan."""
    from pyspark.sql import functions as F

    from evidenza.functions.text import tokenize
    from evidenza.plans.retrieve import retrieve_batch
    from evidenza.sources.fixtures import load, table

    words = table(spark, sf_dir, "documents").select("doc_id", "lang", F.slice(tokenize(F.col("text")), 11, 5).alias("w")).filter("size(w) = 5").orderBy("doc_id").limit(1000)
    listed = [(r["doc_id"], r["lang"], " ".join(r["w"])) for r in words.collect()]
    asked = spark.createDataFrame(listed, "query_id long, tenant_id string, query string")
    return retrieve_batch(load(spark, sf_dir), asked, 10).select("query_id", "rank", "claim_id", "score")


def main() -> None:
    from pyspark.sql import SparkSession

    from evidenza.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [
        "retrieve_lexical", "retrieve_semantic", "retrieve_hybrid_filtered", "retrieve_batch_queries", "retrieve_batch_1000", "vector_topk_exact", "ann_vector_topk", "bm25_scores", "corpus_stats",
        "graph_score", "extract_sentences", "replay_last_write", "segment_build", "tenant_index_stats", "hash_embeddings", "audit_chain_verify",
    ]
    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries = {**QUERIES, "retrieve_batch_1000": batch_1000}
    run(queries["tier_counts"])
    seconds = {}
    for name in names:
        best = []
        for _ in range(2):
            start = time.perf_counter()
            run(queries[name])
            best.append(time.perf_counter() - start)
        seconds[name] = round(min(best), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
