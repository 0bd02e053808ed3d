"""Retrieval as one lazy plan: candidates, filters, scores, top k, projection.

The tenant's filter reaches the scan. One aggregate over the tenant's tokens gives the corpus statistics
and document frequencies of the query's terms; it is a single row. Evidence and edges are reduced, by narrow columns
alone, to claims that pass the filters before they are aggregated, so texts are read twice: for statistics and scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ann
from ..functions.text import tokenize, tokenize_text
from ..functions.vectors import cosine_to
from ..operators import filters, graph, projection, ranking, segments
from ..schema import STANCE_MODES, StoreError, Tables
from ..sources.workspace import written


@dataclass(frozen=True)
class Request:
    tenant_id: str
    query: str
    top_k: int = 5
    stance_mode: str = "balanced"
    time_from: int | None = None
    time_to: int | None = None
    entities: list[str] | None = None
    embedding_ids: list[str] | None = None
    query_vector: list[float] | None = field(default=None, repr=False)
    #: Search signatures instead of all vectors, where these have them.
    ann: ann.AnnConfig | None = None

    def check(self) -> None:
        if self.top_k <= 0:
            raise StoreError("top_k must be positive")
        if self.stance_mode not in STANCE_MODES:
            raise StoreError(f"stance_mode must be one of {STANCE_MODES}")

    @property
    def empty(self) -> bool:
        """An inverted time range holds nothing."""
        return self.time_from is not None and self.time_to is not None and self.time_from > self.time_to

    @property
    def tokens(self) -> list[str]:
        return tokenize_text(self.query)

    @classmethod
    def from_query(cls, values: dict[str, str]) -> Request:
        """From the parameters of a query string."""
        number = lambda k: int(values[k]) if values.get(k) else None
        listed = lambda k: [x.strip() for x in values.get(k, "").split(",") if x.strip()] or None
        if not values.get("tenant_id", "").strip() or not values.get("query", "").strip():
            raise StoreError("tenant_id and query are required")
        out = cls(values["tenant_id"], values["query"], number("top_k") or (5 if not values.get("top_k") else 0), values.get("stance_mode", "balanced"), number("from_unix"), number("to_unix"), listed("entity_filters"), listed("embedding_id_filters"))
        out.check()
        return out

    @classmethod
    def from_json(cls, body: dict) -> Request:
        if not str(body.get("tenant_id", "")).strip() or not str(body.get("query", "")).strip():
            raise StoreError("tenant_id and query are required")
        span = body.get("time_range") or {}
        out = cls(body["tenant_id"], body["query"], body.get("top_k", 5), body.get("stance_mode", "balanced"), span.get("from_unix"), span.get("to_unix"), body.get("entity_filters"), body.get("embedding_id_filters"), body.get("query_embedding"))
        out.check()
        return out


def vector_limit(top_k: int) -> int:
    return min(5000, max(100, 20 * top_k))


def vector_candidates(tables: Tables, tenant_id: str, vector: list[float], n: int) -> DataFrame:
    """(claim_id, cos): the n nearest of a tenant, exact, ties by claim_id."""
    own = tables.claims.filter(F.col("tenant_id") == tenant_id).select("claim_id")
    scored = tables.vectors.join(own, "claim_id").select("claim_id", cosine_to(F.col("values"), vector).alias("cos")).filter("cos is not null")
    return scored.orderBy(F.desc("cos"), "claim_id").limit(n)


def ann_candidates(tables: Tables, tenant_id: str, vector: list[float], n: int, config: ann.AnnConfig = ann.AnnConfig()) -> DataFrame:
    """The same by signatures; vectors without a signature column get one here."""
    own = tables.claims.filter(F.col("tenant_id") == tenant_id).select("claim_id")
    index = tables.vectors if "signature" in tables.vectors.columns else ann.indexed(tables.vectors, config)
    return ann.nearest(index.join(own, "claim_id"), vector, n, config)


def _tenant(tables: Tables, request: Request) -> DataFrame:
    return ranking.with_tokens(tables.claims.filter(F.col("tenant_id") == request.tenant_id))


def _passes(request: Request) -> Column:
    """The filters that need no text."""
    return F.lit(not request.empty) & filters.matches_time(request.time_from, request.time_to) & filters.metadata(request.entities, request.embedding_ids)


def candidates(tables: Tables, request: Request, allowed: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """The tenant's candidate claims with tokens and corpus statistics.

    Claims with a query token, or all if there is none; with a query vector also its nearest. Then the time
    range, the filters, and the allowed ids. `explicit` ids replace the first step.
    """
    request.check()
    own, query = _tenant(tables, request), request.tokens
    found = own.crossJoin(F.broadcast(ranking.corpus_stats(own, query)))
    if explicit is not None:
        found = found.join(explicit.select("claim_id").distinct(), "claim_id", "left_semi")
    else:
        hit = (F.col("n_matched") == 0) | ranking.has_any(F.col("pad"), query) if query else F.lit(True)
        if request.query_vector is not None:
            search = vector_candidates if request.ann is None else ann_candidates
            near = search(tables, request.tenant_id, request.query_vector, vector_limit(request.top_k), *([request.ann] if request.ann else [])).select("claim_id", F.lit(True).alias("near"))
            found = found.join(near, "claim_id", "left")
            hit = hit | F.col("near").isNotNull()
        found = found.filter(hit)
    found = found.filter(_passes(request))
    if allowed is not None:
        found = found.join(allowed.select("claim_id").distinct(), "claim_id", "left_semi")
    return found.drop("near")


def score(tables: Tables, request: Request, found: DataFrame) -> DataFrame:
    ids, query = tables.claims.filter(F.col("tenant_id") == request.tenant_id).filter(_passes(request)).select("claim_id"), request.tokens
    evidence = tables.evidence.join(ids, "claim_id", "left_semi")
    edges = tables.edges.join(ids, F.col("from_claim_id") == F.col("claim_id"), "left_semi")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("supports", "contradicts")} | {"quality": F.coalesce("quality", F.lit(0.0))}
    out = found.join(ranking.signals(evidence, edges), "claim_id", "left").withColumns(zero).filter(filters.stance_allows(request.stance_mode))
    out = out.withColumns({"overlap": ranking.overlap(F.col("pad"), query), "bm25": ranking.bm25(query)})
    lexical = ranking.lexical_score(ranking.base_score(F.col("overlap"), F.col("supports"), F.col("contradicts"), F.col("quality"), F.col("confidence")), F.col("bm25"))
    if request.query_vector is None:
        return out.withColumn("score", lexical)
    cos = tables.vectors.join(ids, "claim_id", "left_semi").select("claim_id", cosine_to(F.col("values"), request.query_vector).alias("cos"))
    return out.join(cos, "claim_id", "left").withColumn("score", ranking.semantic_score(F.col("cos"), lexical))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "claim_id").limit(k)


def retrieve(tables: Tables, request: Request, allowed: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """The k best claims: ties go to the smaller claim_id."""
    return top(score(tables, request, candidates(tables, request, allowed, explicit)), request.top_k)


def citations(tables: Tables, results: DataFrame) -> DataFrame:
    """One row per cited evidence of the results, numbered in the order it came in."""
    order = Window.partitionBy("claim_id").orderBy("seq")
    joined = tables.evidence.join(F.broadcast(results.select("claim_id", "score")), "claim_id")  # at most k results
    return joined.withColumn("position", F.row_number().over(order))


def response(tables: Tables, results: DataFrame) -> DataFrame:
    """One JSON text per result, numbers with six decimals."""
    cited = citations(tables, results).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("position", "evidence_id", "source_id", "stance", "source_quality"))).alias("citations"))
    node = F.struct("claim_id", "canonical_text", F.round("score", 6).alias("score"), "supports", "contradicts", "citations")
    return results.join(cited, "claim_id", "left").select("claim_id", F.to_json(node).alias("json"))


#: Queries of a batch that is sent to all executors whole.
MOST_SENT = 100_000


def retrieve_batch(tables: Tables, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """The k best claims of each row of `queries` (query_id, tenant_id, query), all in one plan.

    Query tokens meet claim tokens by equi-joins, so the work follows the postings that match. A query of which no
    token matches takes its whole tenant. Texts are read twice, for lengths and for the postings of the queries' tokens,
    which are written once to the shared folder. Optional columns, null where they do not count: time_from, time_to (inclusive),
    entities, embedding_ids (arrays, any of them), stance_mode. Evidence and edges are reduced to the claims of the tenants.

    What a batch of at most MOST_SENT queries asks for (tenants, tokens, options) is sent to all executors, so texts are never
    dealt by tenant, postings never by token and candidates never by query: these are a few large groups. A larger batch is
    joined as Spark plans it.
    """
    sent = F.broadcast if queries.limit(MOST_SENT + 1).count() <= MOST_SENT else lambda rows: rows
    given = {"time_from": "long", "time_to": "long", "entities": "array<string>", "embedding_ids": "array<string>", "stance_mode": "string"}
    options = queries.select("query_id", *(F.col(c).cast(d).alias(f"_{c}") if c in queries.columns else F.lit(None).cast(d).alias(f"_{c}") for c, d in given.items()))
    asked = queries.select("query_id", "tenant_id", tokenize(F.col("query")).alias("qtokens"))
    tenants = sent(asked.select("tenant_id").distinct())
    own = ranking.with_tokens(tables.claims.join(tenants, "tenant_id", "left_semi"))
    stats = own.groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.col("n_tokens").cast("double")), F.lit(1.0)).alias("avg_len"))
    terms = asked.select("query_id", "tenant_id", F.size("qtokens").alias("n_terms"), F.explode("qtokens").alias("token"))
    terms = terms.groupBy("query_id", "tenant_id", "n_terms", "token").agg(F.count("*").alias("times"))
    wanted = terms.select("tenant_id", "token").distinct()
    posted = own.select("claim_id", "tenant_id", F.col("n_tokens").cast("double").alias("len"), F.explode(F.split(F.trim("pad"), "  ")).alias("token")).join(sent(wanted), ["tenant_id", "token"])
    posted = written(posted.groupBy("tenant_id", "token", "claim_id", "len").agg(F.count("*").alias("tf")), "postings")
    df = posted.groupBy("tenant_id", "token").agg(F.count("*").alias("df"))
    norm = 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len"))
    gain = F.col("times") * ranking.idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * 2.2) / (F.col("tf") + norm)
    hits = posted.join(sent(terms), ["tenant_id", "token"]).join(sent(df), ["tenant_id", "token"]).join(sent(stats), "tenant_id")
    lexical = hits.groupBy("query_id", "tenant_id", "claim_id").agg(F.sum(gain).alias("bm25"), (F.sum("times") / F.first("n_terms")).alias("overlap"))
    missed = asked.select("query_id", "tenant_id").join(sent(terms.join(sent(df), ["tenant_id", "token"]).select("query_id").distinct()), "query_id", "left_anti")
    whole = tables.claims.select("tenant_id", "claim_id").join(sent(missed), "tenant_id").select("query_id", "tenant_id", "claim_id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("overlap"))
    narrow = tables.claims.select("claim_id", "confidence", *(c for c in filters.METADATA if c in tables.claims.columns))
    found = lexical.union(whole).join(narrow, "claim_id").join(sent(options), "query_id")
    found = found.filter(filters.passes_options(tables.claims.columns)).select("query_id", "tenant_id", "claim_id", "bm25", "overlap", "confidence", "_stance_mode")
    ids = tables.claims.join(tenants, "tenant_id", "left_semi").select("claim_id")  # narrow columns of the tenants asked for
    evidence = tables.evidence.join(ids, "claim_id", "left_semi")
    edges = tables.edges.join(ids, F.col("from_claim_id") == F.col("claim_id"), "left_semi")
    found = found.join(ranking.signals(evidence, edges), "claim_id", "left")
    found = found.withColumns({"supports": F.coalesce("supports", F.lit(0)), "contradicts": F.coalesce("contradicts", F.lit(0)), "quality": F.coalesce("quality", F.lit(0.0))})
    found = found.filter(~F.coalesce(F.col("_stance_mode") == "support_only", F.lit(False)) | filters.stance_allows("support_only")).drop("_stance_mode")
    base = ranking.base_score(F.col("overlap"), F.col("supports"), F.col("contradicts"), F.col("quality"), F.col("confidence"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "claim_id")
    return found.withColumn("score", ranking.lexical_score(base, F.col("bm25"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def api_query(tables: Tables, request: Request, base: DataFrame | None = None, config: graph.GraphConfig = graph.GraphConfig(max_hops=1)) -> DataFrame:
    """The whole answer to a request, a row for each result: score, stances, citations, bands, time notes, graph score, and
    whether it came from `base` (claim ids) or the delta beyond it."""
    own = tables.claims.filter(F.col("tenant_id") == request.tenant_id)
    results = retrieve(tables, request)
    cited = citations(tables, results).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("position", "evidence_id", "source_id", "stance", "source_quality"))).alias("citations"))
    reasoned = graph.reasoning(results, graph.traverse(results, tables.edges, config.max_hops), config)
    seen = segments.visible(own, base) if base is not None else own.select("claim_id", F.lit("delta").alias("origin"))
    s, c = F.col("supports"), F.col("contradicts")
    out = results.join(cited, "claim_id", "left").join(reasoned, "claim_id", "left").join(seen, "claim_id", "left")
    return out.withColumns({
        "citations": F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)), "band": projection.confidence_band(F.col("confidence")), "dominant": projection.dominant_stance(s, c), "risk": projection.contradiction_risk(s, c),
        "temporal_mode": projection.temporal_mode(request.time_from, request.time_to), "in_range": projection.temporal_match(request.time_from, request.time_to),
    }).select("claim_id", "canonical_text", "score", "supports", "contradicts", "quality", "citations", "band", "dominant", "risk", "temporal_mode", "in_range", "graph_score", "support_path_count", "contradiction_chain_depth", "origin")


def planner_snapshot(tables: Tables, request: Request, allowed: DataFrame | None = None) -> DataFrame:
    """One row of what the plan does for a request: counts on the way, limits, and which parts are in use."""
    counts = candidate_counts(tables, request, allowed)
    vector = request.query_vector is not None
    near = vector_candidates(tables, request.tenant_id, request.query_vector, vector_limit(request.top_k)).agg(F.count("*").alias("vector_candidates")) if vector else counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("vector_candidates"))
    shown = counts.crossJoin(near)  # one row each
    return shown.withColumns({
        "query_tokens": F.lit(len(request.tokens)).cast("long"), "vector_limit": F.lit(vector_limit(request.top_k) if vector else 0).cast("long"), "semantic": F.lit(vector), "time_filter": F.lit(request.time_from is not None or request.time_to is not None),
        "metadata_filter": F.lit(bool(request.entities or request.embedding_ids)), "allowed_filter": F.lit(allowed is not None), "short_circuit": F.lit(request.empty), "stance_mode": F.lit(request.stance_mode),
    })


def candidate_counts(tables: Tables, request: Request, allowed: DataFrame | None = None) -> DataFrame:
    """One row: claims of the tenant, claims with a query token, claims that pass the filters, candidates."""
    own, query = _tenant(tables, request), request.tokens
    hit = ranking.has_any(F.col("pad"), query)
    passed = filters.matches_time(request.time_from, request.time_to) & filters.metadata(request.entities, request.embedding_ids)
    counts = own.agg(F.count("*").alias("tenant_claims"), F.count_if(hit).alias("matched"), F.count_if(passed).alias("allowed"))
    return counts.crossJoin(candidates(tables, request, allowed).agg(F.count("*").alias("candidates")))
