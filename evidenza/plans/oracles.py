"""The registered queries in DuckDB's SQL, written apart from the plans they are held against."""

from __future__ import annotations

from ..sources.fixtures import SQL as TABLES

FROM, TO = 1704153600, 1705795200
ORACLES: dict[str, str] = {}


def _retrieval(tenant="en", tokens=("the", "of", "and", "the"), k=20, support_only=False, time=False, entities=None, embeddings=None, vector=None, only=None, allowed=None, all_claims=False, tail=None) -> str:
    quoted = ", ".join(f"'{t}'" for t in tokens)
    query = f"SELECT unnest([{quoted}]) AS t" if tokens else "SELECT NULL::VARCHAR AS t WHERE false"
    distinct = f"[{', '.join(repr(t) for t in dict.fromkeys(tokens))}]" if tokens else "[]::VARCHAR[]"
    where = ["true"]
    if time:
        at, over = f"event_time_unix BETWEEN {FROM} AND {TO}", f"coalesce(valid_from, 0) <= {TO} AND coalesce(valid_to, 9e15) >= {FROM}"
        where.append(
            f"CASE WHEN event_time_unix IS NOT NULL AND (valid_from IS NOT NULL OR valid_to IS NOT NULL) THEN {at} AND {over} WHEN event_time_unix IS NOT NULL THEN {at} WHEN valid_from IS NOT NULL OR valid_to IS NOT NULL THEN {over} ELSE false END"
        )
    if entities:
        where.append(f"lower(trim(entity)) IN ({', '.join(repr(e) for e in entities)})")
    if embeddings:
        where.append(f"embedding_id IN ({', '.join(repr(e) for e in embeddings)})")
    if allowed:
        where.append(allowed)
    if only:
        chosen = only
    elif all_claims:
        chosen = "true"
    else:
        chosen = f"(list_has_any(toks, {distinct}) OR (SELECT count(*) FROM own WHERE list_has_any(toks, {distinct})) = 0" + (" OR claim_id IN (SELECT claim_id FROM near))" if vector is not None else ")")
    semantic = "(coalesce((SELECT cos FROM cosines k WHERE k.claim_id = x.claim_id), 0) + 1) * 0.5 + 0.1 * lexical" if vector is not None else "lexical"
    vectors = (
        f""",
cosines AS (SELECT claim_id, list_cosine_similarity(vals, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vector})) AS cos FROM vectors),
near AS (SELECT claim_id FROM cosines JOIN own USING (claim_id) ORDER BY cos DESC, claim_id LIMIT {min(5000, max(100, 20 * k))})"""
        if vector is not None
        else ""
    )
    return f"""{TABLES},
own AS (SELECT c.*, t.toks FROM claims c JOIN tokens t USING (claim_id) WHERE c.tenant_id = '{tenant}'),
q AS ({query}),
stats AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM own),
df AS (SELECT t, (SELECT count(*) FROM own WHERE list_contains(toks, t)) AS df FROM (SELECT DISTINCT t FROM q)){vectors},
cand AS (SELECT * FROM own WHERE {chosen} AND {" AND ".join(where)}),
tf AS (SELECT claim_id, q.t, len(list_filter(toks, lambda x: x = q.t)) AS tf, len(toks) AS dl FROM cand, q),
lex AS (SELECT claim_id, sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS bm25,
  sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) / count(*) AS overlap FROM tf JOIN df USING (t), stats GROUP BY claim_id),
ev AS (SELECT claim_id, count(*) FILTER (stance = 'supports') AS s, count(*) FILTER (stance = 'contradicts') AS c, avg(source_quality) AS quality FROM evidence GROUP BY claim_id),
ed AS (SELECT from_claim_id AS claim_id, count(*) FILTER (relation = 'supports') AS s, count(*) FILTER (relation = 'contradicts') AS c FROM edges GROUP BY 1),
x AS (SELECT cand.claim_id, coalesce(ev.s, 0) + coalesce(ed.s, 0) AS supports, coalesce(ev.c, 0) + coalesce(ed.c, 0) AS contradicts, coalesce(quality, 0) AS quality, confidence,
  coalesce(bm25, 0) AS bm25, coalesce(overlap, 0) AS overlap FROM cand LEFT JOIN ev USING (claim_id) LEFT JOIN ed USING (claim_id) LEFT JOIN lex USING (claim_id)),
y AS (SELECT *, 0.72 * (0.6 * overlap + 0.08 * supports - 0.10 * contradicts + 0.15 * quality + 0.25 * confidence) + 0.28 * greatest(bm25, 0) AS lexical FROM x),
result AS (SELECT claim_id, {semantic} AS score, supports, contradicts, quality FROM y AS x {"WHERE NOT contradicts > supports" if support_only else ""} ORDER BY score DESC, claim_id LIMIT {k})
""" + (tail or "SELECT claim_id, round(score, 6) AS score, CAST(supports AS BIGINT) AS supports, CAST(contradicts AS BIGINT) AS contradicts, round(quality, 6) AS quality FROM result")


ORACLES |= {
    "retrieve_lexical": _retrieval(),
    "retrieve_support_only": _retrieval(support_only=True),
    "retrieve_time_range": _retrieval(time=True),
    "retrieve_empty_query_all_tenant": _retrieval(tokens=(), all_claims=True),
    "retrieve_no_match_fallback": _retrieval(tokens=("zzzzqq", "xxyyzz")),
    "retrieve_entity_filter": _retrieval(entities=["src1", "src7"]),
    "retrieve_entity_and_embedding_filter": _retrieval(entities=["src1", "src3"], embeddings=["emb-1", "emb-13", "emb-43"]),
    "retrieve_explicit_candidates": _retrieval(only="claim_id LIKE '%7'"),
    "retrieve_allowed": _retrieval(allowed="confidence >= 0.5"),
    "retrieve_semantic": _retrieval(vector=0),
    "retrieve_hybrid_filtered": _retrieval(tokens=("thou", "reshes"), support_only=True, time=True, vector=7),
    "citation_rows": _retrieval(
        tail="SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY event_id) AS INTEGER) AS position, evidence_id, source_id, stance, round(source_quality, 6) AS source_quality FROM evidence JOIN result USING (claim_id)"
    ),
    "result_provenance": _retrieval(
        tail="SELECT count(*) FILTER (confidence >= 0.3) AS from_base, count(*) FILTER (confidence < 0.3) AS from_delta, CAST(0 AS BIGINT) AS outside FROM result JOIN claims USING (claim_id)"
    ),
    "candidate_ids": _retrieval("fr", ("eau", "elle"), 5, vector=0, tail="SELECT claim_id FROM cand"),
    "candidate_count": _retrieval(
        tokens=("thou", "reshes"), k=5, time=True, entities=["src1", "src2", "src3"],
        tail="SELECT (SELECT count(*) FROM own) AS tenant_claims, (SELECT count(*) FROM own WHERE list_has_any(toks, ['thou', 'reshes'])) AS matched, (SELECT count(*) FROM own WHERE {w}) AS allowed, (SELECT count(*) FROM cand) AS candidates",
    ),
}
_WHERE = ORACLES["candidate_count"].split("cand AS (SELECT * FROM own WHERE ", 1)[1].split("true AND ", 1)[1].split("),\ntf AS", 1)[0]
ORACLES["candidate_count"] = ORACLES["candidate_count"].replace("{w}", _WHERE)

_BATCH = [(0, "en", "the of and the"), (1, "de", "der die und"), (2, "fr", "le la zzzz"), (3, "es", "zzzzqq"), (4, "en", "ing tion")]
ORACLES["retrieve_batch_queries"] = "\nUNION ALL\n".join(
    "SELECT * FROM (" + _retrieval(tenant, tuple(text.split()), 10, tail=f"SELECT CAST({i} AS BIGINT) AS query_id, row_number() OVER (ORDER BY score DESC, claim_id) AS rank, claim_id, round(score, 6) AS score FROM result") + ")"
    for i, tenant, text in _BATCH
)

_SIGNALS = f"""{TABLES},
ev AS (SELECT claim_id, count(*) FILTER (stance = 'supports') AS s, count(*) FILTER (stance = 'contradicts') AS c, avg(source_quality) AS quality FROM evidence GROUP BY claim_id),
ed AS (SELECT from_claim_id AS claim_id, count(*) FILTER (relation = 'supports') AS s, count(*) FILTER (relation = 'contradicts') AS c FROM edges GROUP BY 1),
signals AS (SELECT claim_id, confidence, coalesce(ev.s, 0) + coalesce(ed.s, 0) AS supports, coalesce(ev.c, 0) + coalesce(ed.c, 0) AS contradicts, coalesce(quality, 0) AS quality
  FROM claims LEFT JOIN ev USING (claim_id) LEFT JOIN ed USING (claim_id))"""
_EVENT, _WINDOW = f"event_time_unix BETWEEN {FROM} AND {TO}", f"(valid_from IS NULL OR valid_from <= {TO}) AND (valid_to IS NULL OR valid_to >= {FROM})"
_HAS = "valid_from IS NOT NULL OR valid_to IS NOT NULL"
_IN_RANGE = f"CASE WHEN event_time_unix IS NOT NULL AND ({_HAS}) THEN {_EVENT} AND {_WINDOW} WHEN event_time_unix IS NOT NULL THEN {_EVENT} WHEN {_HAS} THEN {_WINDOW} ELSE false END"
_OVERLAP = "(list_contains(toks,'the')::INT + list_contains(toks,'of')::INT + list_contains(toks,'and')::INT + list_contains(toks,'the')::INT) / 4.0"
_START = "start AS (SELECT claim_id FROM claims WHERE tenant_id = 'en' AND confidence >= 0.97)"
_DEPTHS = """d1 AS (SELECT DISTINCT to_claim_id AS node FROM edges WHERE from_claim_id IN (SELECT claim_id FROM start) AND to_claim_id NOT IN (SELECT claim_id FROM start)),
d2 AS (SELECT DISTINCT to_claim_id AS node FROM edges WHERE from_claim_id IN (SELECT node FROM d1) AND to_claim_id NOT IN (SELECT claim_id FROM start) AND to_claim_id NOT IN (SELECT node FROM d1)),
depths AS (SELECT claim_id AS node, 0 AS depth FROM start UNION ALL SELECT node, 1 FROM d1)"""
_WEIGHT = "CASE relation WHEN 'supports' THEN 1.0 WHEN 'contradicts' THEN -1.0 WHEN 'refines' THEN 0.55 WHEN 'duplicates' THEN 0.35 ELSE 0.2 END"


def _paths(edges: str, hops: int) -> str:
    out = "p0 AS (SELECT claim_id, 1 AS paths FROM start)"
    for h in range(1, hops + 1):
        out += f",\np{h} AS (SELECT to_claim_id AS claim_id, sum(paths) AS paths FROM {edges} JOIN p{h - 1} ON from_claim_id = claim_id WHERE relation = 'supports' GROUP BY 1)"
    return out + ",\npaths AS (SELECT claim_id, CAST(sum(paths) AS BIGINT) AS paths FROM (" + " UNION ALL ".join(f"SELECT * FROM p{h}" for h in range(hops + 1)) + ") GROUP BY 1)"


def _runs(edges: str, hops: int) -> str:
    out = "r0 AS (SELECT claim_id, 0 AS depth FROM start)"
    for h in range(1, hops + 1):
        out += f",\nr{h} AS (SELECT to_claim_id AS claim_id, max(CASE WHEN relation = 'contradicts' THEN r{h - 1}.depth + 1 ELSE 0 END) AS depth FROM {edges} JOIN r{h - 1} ON from_claim_id = claim_id GROUP BY 1)"
    return out + ",\nruns AS (SELECT claim_id, CAST(max(depth) AS BIGINT) AS depth FROM (" + " UNION ALL ".join(f"SELECT * FROM r{h}" for h in range(hops + 1)) + ") GROUP BY 1)"


def _reasoning(hops: int) -> str:
    return f"""walked AS (SELECT e.*, depth FROM edges e JOIN depths ON from_claim_id = node),
incoming AS (SELECT to_claim_id AS claim_id, sum({_WEIGHT} * strength * pow(0.75, depth)) AS incoming FROM walked GROUP BY 1),
{_paths("walked", hops)},
{_runs("walked", hops)},
nodes AS (SELECT claim_id FROM start UNION SELECT from_claim_id FROM walked UNION SELECT to_claim_id FROM walked),
scores AS (SELECT claim_id, (tanh(coalesce(incoming, 0) + 0.16 * ln(1 + coalesce(paths, 0)) - 0.20 * pow(coalesce(depth, 0), 1.25)) + 1) * 0.5 AS graph_score, coalesce(paths, 0) AS paths, coalesce(depth, 0) AS depth
  FROM nodes LEFT JOIN incoming USING (claim_id) LEFT JOIN paths USING (claim_id) LEFT JOIN runs USING (claim_id))"""


_SEGMENTS = f"""{TABLES},
tiered AS (SELECT claim_id, CASE WHEN confidence >= 0.85 THEN 'hot' WHEN confidence >= 0.6 THEN 'warm' ELSE 'cold' END AS tier FROM claims WHERE tenant_id = 'en'),
segs AS (SELECT tier, claim_id, (row_number() OVER (PARTITION BY tier ORDER BY claim_id) - 1) // 16 AS n FROM tiered)"""
_VISIBLE = f"""{TABLES},
own AS (SELECT * FROM claims WHERE tenant_id = 'en'),
base AS (SELECT claim_id FROM own WHERE confidence >= 0.3 UNION ALL SELECT 'gone-1' UNION ALL SELECT 'gone-2'),
seen AS (SELECT claim_id, 'base' AS origin FROM base UNION ALL SELECT claim_id, 'delta' FROM own WHERE claim_id NOT IN (SELECT claim_id FROM base))"""
_LOG = """log AS (SELECT o_orderkey * 2 AS "offset", 'C' AS kind, 'k' || CAST(o_orderkey % 97 AS VARCHAR) AS claim_id, 'text ' || CAST(o_orderkey AS VARCHAR) AS body,
    'C' || chr(9) || 'k' || CAST(o_orderkey % 97 AS VARCHAR) || chr(9) || 't1' || chr(9) || 'text ' || CAST(o_orderkey AS VARCHAR) || chr(9) || '0.5' || chr(9) || 'null' AS line FROM orders
  UNION ALL SELECT o_orderkey * 2 - 3, 'V', 'k' || CAST(o_orderkey % 89 AS VARCHAR), CAST(o_orderkey % 10 AS VARCHAR) || '.5',
    'V' || chr(9) || 'k' || CAST(o_orderkey % 89 AS VARCHAR) || chr(9) || CAST(o_orderkey % 10 AS VARCHAR) || '.5,1' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey * 2 - 3 > 0)"""
_PLACEMENTS = """p AS (SELECT 't' || CAST(i // 24 AS VARCHAR) AS tenant_id, i // 3 % 8 AS shard_id, i // 3 % 8 + 1 AS epoch, 'node-' || CAST(i % 3 AS VARCHAR) AS node_id,
  CASE WHEN i % 3 = (i // 3 % 8) % 3 THEN 'leader' ELSE 'follower' END AS role, CASE WHEN i % 7 = 0 THEN 'unavailable' WHEN i % 5 = 0 THEN 'degraded' ELSE 'healthy' END AS health, i % 3 AS pos FROM range(96) t(i))"""
_SENTENCE_PARTS = """parts AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n\\r]')) AS raw, generate_subscripts(string_split_regex(text, '[.!?\\n\\r]'), 1) AS i FROM documents),
placed AS (SELECT doc_id, i, raw, strlen(raw) + 1 AS width, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM parts),
kept AS (SELECT doc_id, i, raw, place, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS sentence FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal FROM kept WHERE length(sentence) >= 24)"""

ORACLES |= {
    "baseline_overlap_top": f"{TABLES} SELECT claim_id, round({_OVERLAP}, 6) AS overlap FROM tokens WHERE tenant_id = 'en' ORDER BY overlap DESC, claim_id LIMIT 1",
    "vector_topk_exact": f"{TABLES} SELECT claim_id, round(cos, 6) AS cos FROM (SELECT claim_id, list_cosine_similarity(vals, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cos FROM vectors JOIN claims USING (claim_id) WHERE tenant_id = 'en' ORDER BY cos DESC, claim_id LIMIT 100)",
    "vector_validity": "SELECT CASE vec_id % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_finite' ELSE 'ok' END AS outcome, count(*) AS n FROM embeddings GROUP BY 1",
    "lexical_overlap": f"{TABLES} SELECT claim_id, round({_OVERLAP}, 6) AS overlap FROM tokens",
    "bm25_scores": f"""{TABLES}, own AS (SELECT * FROM tokens WHERE tenant_id = 'en'), q AS (SELECT unnest(['the', 'of', 'and', 'the']) AS t),
stats AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM own), df AS (SELECT t, (SELECT count(*) FROM own WHERE list_contains(toks, t)) AS df FROM (SELECT DISTINCT t FROM q)),
tf AS (SELECT claim_id, t, len(list_filter(toks, lambda x: x = t)) AS tf, len(toks) AS dl FROM own, q)
SELECT claim_id, round(sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 6) AS bm25 FROM tf JOIN df USING (t), stats GROUP BY claim_id""",
    "doc_freq": f"{TABLES} SELECT tenant_id, token, count(*) AS df FROM (SELECT tenant_id, unnest(list_distinct(toks)) AS token FROM tokens) GROUP BY 1, 2",
    "term_freq": f"{TABLES} SELECT claim_id, token, count(*) AS tf FROM (SELECT claim_id, unnest(toks) AS token FROM tokens WHERE tenant_id = 'es') GROUP BY 1, 2",
    "corpus_stats": f"{TABLES} SELECT tenant_id, count(*) AS n_docs, round(greatest(avg(len(toks)), 1.0), 6) AS avg_len FROM tokens GROUP BY 1",
    "stance_counts": f"{_SIGNALS} SELECT claim_id, supports, contradicts FROM signals",
    "evidence_quality": f"{_SIGNALS} SELECT claim_id, round(quality, 6) AS quality FROM signals",
    "edge_summary": f"{TABLES} SELECT from_claim_id, count(*) FILTER (relation = 'supports') AS supports, count(*) FILTER (relation = 'contradicts') AS contradicts, count(*) FILTER (relation = 'refines') AS refines, count(*) FILTER (relation = 'duplicates') AS duplicates, count(*) FILTER (relation = 'depends_on') AS depends_on, round(sum(strength), 6) AS strength, count(*) AS n_edges FROM edges GROUP BY 1",
    "claim_edges": f"{TABLES} SELECT edge_id, to_claim_id, relation, round(strength, 6) AS strength FROM edges WHERE from_claim_id = 'doc-00000005'",
    "confidence_bands": f"{TABLES} SELECT claim_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM claims",
    "contradiction_risk": f"{_SIGNALS} SELECT claim_id, CASE WHEN supports > contradicts THEN 'supports' WHEN contradicts > supports THEN 'contradicts' WHEN supports > 0 THEN 'balanced' END AS stance, CASE WHEN supports + contradicts > 0 THEN round(contradicts / (supports + contradicts), 6) END AS risk FROM signals",
    "temporal_annotation": f"{TABLES} SELECT claim_id, CASE WHEN event_time_unix IS NOT NULL AND ({_HAS}) THEN 'event_and_validity_window' WHEN event_time_unix IS NOT NULL THEN 'event_time' WHEN {_HAS} THEN 'validity_window' ELSE 'no_temporal_data' END AS mode, {_IN_RANGE} AS in_range FROM claims",
    "time_range_filter": f"{TABLES} SELECT claim_id FROM claims WHERE {_IN_RANGE}",
    "entity_lookup": f"{TABLES} SELECT claim_id FROM claims WHERE tenant_id = 'de' AND lower(entity) = 'src4' ORDER BY claim_id",
    "tenant_list": "SELECT DISTINCT lang AS tenant_id FROM documents ORDER BY 1",
    "tenant_index_stats": f"""{TABLES} SELECT tenant_id, count(*) AS claims, count(event_time_unix) AS event_times, (SELECT count(DISTINCT x) FROM (SELECT unnest(toks) AS x FROM tokens t WHERE t.tenant_id = c.tenant_id)) AS terms,
count(DISTINCT lower(entity)) AS entities, count(DISTINCT embedding_id) AS embedding_ids, (SELECT count(*) FROM vectors v JOIN claims d USING (claim_id) WHERE d.tenant_id = c.tenant_id) AS vectors FROM claims c GROUP BY tenant_id""",
    "tier_counts": f"{TABLES} SELECT CASE WHEN confidence >= 0.85 THEN 'hot' WHEN confidence >= 0.6 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM claims GROUP BY 1",
    "segment_build": f"{_SEGMENTS} SELECT tier, tier || '-' || CAST(n AS VARCHAR) AS segment_id, claim_id FROM segs",
    "segment_compaction": f"{_SEGMENTS} SELECT tier, CASE WHEN (SELECT count(DISTINCT n) FROM segs t WHERE t.tier = segs.tier) > 8 AND n < 4 THEN tier || '-merged' ELSE tier || '-' || CAST(n AS VARCHAR) END AS segment_id, claim_id FROM segs",
    "base_delta_visibility": f"{_VISIBLE} SELECT * FROM seen",
    "storage_divergence": f"{_VISIBLE}, n AS (SELECT count(*) FILTER (origin = 'base') AS base, count(*) FILTER (origin = 'delta') AS delta FROM seen) SELECT base, delta, round(delta / (base + delta), 6) AS ratio, delta > 0 AND (delta >= 1000 OR delta / (base + delta) >= 0.25) AS warn FROM n",
    "promotion_boundary": f"{TABLES}, d AS (SELECT tenant_id, count(*) FILTER (confidence < 0.02) AS delta FROM claims GROUP BY 1) SELECT tenant_id, CASE WHEN tenant_id = 'es' THEN 'replay_only' WHEN delta = 0 THEN 'fully_promoted' ELSE 'promotion_in_transition' END AS state, CAST(CASE WHEN tenant_id = 'es' THEN 0 WHEN delta = 0 THEN 2 ELSE 1 END AS BIGINT) AS code FROM d",
    "graph_traverse": f"{TABLES}, {_START}, {_DEPTHS} SELECT edge_id, from_claim_id, to_claim_id FROM edges WHERE from_claim_id IN (SELECT node FROM depths)",
    "graph_min_depth": f"{TABLES}, {_START}, {_DEPTHS} SELECT node, CAST(depth AS BIGINT) AS depth FROM depths UNION ALL SELECT node, 2 FROM d2",
    "graph_incoming_weight": f"{TABLES}, {_START}, {_DEPTHS} SELECT to_claim_id AS claim_id, round(sum({_WEIGHT} * strength * pow(0.75, depth)), 6) AS incoming FROM edges JOIN depths ON from_claim_id = node GROUP BY 1",
    "graph_support_paths": f"{TABLES}, {_START}, {_paths('edges', 3)} SELECT * FROM paths",
    "graph_contradiction_depth": f"{TABLES}, {_START}, {_runs('edges', 3)} SELECT * FROM runs",
    "graph_score": f"{TABLES}, {_START}, {_DEPTHS}, {_reasoning(2)} SELECT claim_id, round(graph_score, 6) AS graph_score, paths, depth FROM scores",
    "graph_nodes": _retrieval(k=5, tail="SELECT 1") .rsplit("SELECT 1", 1)[0] + f", start AS (SELECT claim_id FROM result), depths AS (SELECT claim_id AS node, 0 AS depth FROM start), {_reasoning(1)} SELECT s.claim_id, round(coalesce(r.score, 0), 6) AS score, round(graph_score, 6) AS graph_score FROM scores s JOIN own USING (claim_id) LEFT JOIN result r USING (claim_id)",
    "validate_claims": "SELECT CASE doc_id % 100 WHEN 1 THEN 'tenant_id' WHEN 2 THEN 'canonical_text' WHEN 3 THEN 'confidence' WHEN 4 THEN 'entities' WHEN 6 THEN 'valid_window' ELSE 'ok' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "validate_evidence": "SELECT CASE event_id % 10 WHEN 1 THEN 'source_quality' WHEN 2 THEN 'stance' WHEN 3 THEN 'span' WHEN 4 THEN 'span_order' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "extract_sentences": f"WITH {_SENTENCE_PARTS} SELECT doc_id, ordinal, sentence, CAST(place + strlen(raw) - strlen(regexp_replace(raw, '^\\s+', '')) AS BIGINT) AS span_start, CAST(place + strlen(raw) - (strlen(raw) - strlen(regexp_replace(raw, '\\s+$', ''))) - 1 AS BIGINT) AS span_end FROM ranked WHERE ordinal <= 32",
    "extract_claims": f"WITH {_SENTENCE_PARTS} SELECT 'raw:' || lang || ':doc--' || CAST(doc_id AS VARCHAR) || ':c' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS claim_id, 'raw:' || lang || ':doc--' || CAST(doc_id AS VARCHAR) || ':e' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS evidence_id, 'sentence-' || CAST(ordinal AS VARCHAR) AS chunk_id, 'Doc #' || CAST(doc_id AS VARCHAR) AS doc_id FROM ranked JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE ordinal <= 32",
    "sanitize_ids": "SELECT page_id, CASE WHEN x = '' THEN 'raw' ELSE x END AS id, lower(trim(url)) AS key FROM (SELECT page_id, url, trim(left(lower(regexp_replace(url, '[^A-Za-z0-9_:-]', '-', 'g')), 24), '-') AS x FROM pages)",
    "replay_last_write": f"WITH {_LOG} SELECT claim_id, 't1' AS tenant_id, arg_max(body, \"offset\") AS canonical_text, max(\"offset\") AS \"offset\" FROM log WHERE kind = 'C' GROUP BY claim_id",
    "replay_vector_survival": f"WITH {_LOG}, v AS (SELECT claim_id, arg_max(body, \"offset\") AS body, max(\"offset\") AS latest FROM log WHERE kind = 'V' GROUP BY 1), c AS (SELECT claim_id, max(\"offset\") AS changed FROM log WHERE kind = 'C' GROUP BY 1) SELECT claim_id, CAST(body AS DOUBLE) AS first, CAST(2 AS BIGINT) AS n FROM v JOIN c USING (claim_id) WHERE latest > changed",
    "replication_window": f"WITH {_LOG} SELECT \"offset\", line FROM log WHERE \"offset\" >= 1000 AND \"offset\" < 1512",
    "log_encode_claims": f"""{TABLES}, f AS (SELECT *, canonical_text AS body FROM claims)
SELECT concat_ws(chr(9), 'C', claim_id, tenant_id, replace(replace(replace(body, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), '0.5', coalesce(CAST(event_time_unix AS VARCHAR), 'null'), CAST(strlen(entity) AS VARCHAR) || ':' || entity, CAST(strlen(embedding_id) AS VARCHAR) || ':' || embedding_id, 'null', coalesce(CAST(valid_from AS VARCHAR), 'null'), coalesce(CAST(valid_to AS VARCHAR), 'null'), 'null', 'null') AS line FROM f""",
    "commit_idempotency": "SELECT CASE WHEN o_orderkey % 2 <> 0 THEN 'new' WHEN o_orderstatus = 'O' THEN 'repeated' ELSE 'conflict' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "ack_quorum": "WITH a AS (SELECT event_id % 700 AS b, count(DISTINCT user_id % 5) AS acks FROM events GROUP BY 1), r AS (SELECT *, CASE b % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS required FROM a) SELECT 'b' || CAST(b AS VARCHAR) AS commit_id, acks, CAST(required AS BIGINT) AS required, CASE WHEN acks >= required THEN 'quorum_met' ELSE 'pending' END AS status FROM r",
    "placement_read_route": f"WITH {_PLACEMENTS} SELECT tenant_id, shard_id, epoch, node_id, role FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, shard_id ORDER BY CASE role WHEN 'follower' THEN 0 ELSE 1 END, pos) AS r FROM p WHERE health <> 'unavailable') WHERE r = 1",
    "placement_write_route": f"WITH {_PLACEMENTS} SELECT tenant_id, shard_id, epoch, node_id, role FROM p WHERE role = 'leader' AND health = 'healthy'",
    "promote_replica": f"WITH {_PLACEMENTS}, t AS (SELECT tenant_id, shard_id FROM p WHERE node_id = 'node-1' AND role <> 'leader' AND health <> 'unavailable') SELECT p.tenant_id, p.shard_id, epoch + (t.shard_id IS NOT NULL)::BIGINT AS epoch, node_id, CASE WHEN t.shard_id IS NULL THEN role WHEN node_id = 'node-1' THEN 'leader' ELSE 'follower' END AS role, health FROM p LEFT JOIN t USING (tenant_id, shard_id)",
    "read_consistency": f"WITH {_PLACEMENTS} SELECT tenant_id, shard_id, count(*) FILTER (health <> 'unavailable') AS usable, CAST(2 AS BIGINT) AS required, count(*) FILTER (health <> 'unavailable') >= 2 AS met FROM p GROUP BY 1, 2",
    "access_decisions": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'revoked' WHEN c_custkey % 5 = 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'allowed' ELSE 'forbidden' END WHEN c_custkey % 5 = 4 THEN 'unauthorized' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'allowed' ELSE 'forbidden' END AS decision FROM customer",
    "contradiction_f1": f"{_SIGNALS}, n AS (SELECT count(*) FILTER (contradicts > supports AND confidence < 0.5) AS tp, count(*) FILTER (contradicts > supports AND confidence >= 0.5) AS fp, count(*) FILTER (contradicts <= supports AND confidence < 0.5) AS fn FROM signals) SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n",
    "citation_coverage": f"{TABLES} SELECT count(*) AS n, count(*) FILTER (claim_id IN (SELECT claim_id FROM evidence)) AS covered, round(count(*) FILTER (claim_id IN (SELECT claim_id FROM evidence)) / count(*), 6) AS coverage FROM claims",
    "latency_quantile": "SELECT l_extendedprice AS value FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET (SELECT CAST(round((count(*) - 1) * 0.95) AS BIGINT) FROM lineitem)",
    "sliding_latency": "SELECT event_id, round(w[CAST(round((len(w) - 1) * 0.95) + 1 AS BIGINT)], 6) AS quantile FROM (SELECT event_id, list_sort(list(value + 0.0) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2047 PRECEDING AND CURRENT ROW)) AS w FROM events)",
    "visible_lag": f"{TABLES} SELECT round(avg(({TO} - event_time_unix) * 1000), 3) AS lag_ms FROM claims WHERE event_time_unix <= {TO}",
    "write_routing_key": "SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS claim_id, source AS key FROM documents",
    "audit_chain_verify": """WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS VARCHAR) || ',' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
chain AS (SELECT user_id, payload, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.user_id, e.payload, e.seq, c.hash, sha256(c.hash || '|' || e.payload) FROM chain c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1),
bad AS (SELECT user_id, seq, prev_hash, hash, CASE WHEN seq % 11 = 0 THEN 'x' ELSE payload END AS payload FROM chain WHERE seq % 13 <> 5),
seen AS (SELECT *, lag(hash) OVER w AS before, lag(seq) OVER w AS last FROM bad WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT CASE WHEN coalesce(seq <> last + 1, seq < 1) THEN 'seq' WHEN before IS NOT NULL AND prev_hash <> before THEN 'prev_hash' WHEN hash <> sha256(prev_hash || '|' || payload) THEN 'hash' ELSE 'ok' END AS fault, count(*) AS n FROM seen GROUP BY 1""",
    "health_metrics": f"""{TABLES}, s AS (SELECT tenant_id, count(*) AS claims, count(event_time_unix) AS event_times, (SELECT count(DISTINCT x) FROM (SELECT unnest(toks) AS x FROM tokens t WHERE t.tenant_id = c.tenant_id)) AS terms,
count(DISTINCT lower(entity)) AS entities, count(DISTINCT embedding_id) AS embedding_ids, (SELECT count(*) FROM vectors v JOIN claims d USING (claim_id) WHERE d.tenant_id = c.tenant_id) AS vectors FROM claims c GROUP BY tenant_id)
SELECT name, tenant_id, CAST(value AS DOUBLE) AS value FROM (UNPIVOT s ON claims, event_times, terms, entities, embedding_ids, vectors INTO NAME name VALUE value)
UNION ALL SELECT 'tier_' || CASE WHEN confidence >= 0.85 THEN 'hot' WHEN confidence >= 0.6 THEN 'warm' ELSE 'cold' END, tenant_id, CAST(count(*) AS DOUBLE) FROM claims GROUP BY 1, 2""",
    "ingest_requests": "SELECT doc_id, CASE WHEN doc_id % 10 <> 6 THEN 'c' || CAST(doc_id AS VARCHAR) END AS claim_id, CASE doc_id % 10 WHEN 6 THEN NULL WHEN 3 THEN 1 ELSE 2 END::BIGINT AS n_vector, CASE doc_id % 10 WHEN 6 THEN 0 ELSE 1 END::BIGINT AS n_evidence, CASE doc_id % 10 WHEN 1 THEN 'claim_type' WHEN 4 THEN 'evidence_claim' WHEN 5 THEN 'stance' WHEN 6 THEN 'body' END AS error FROM documents",
    "stream_event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value) + 0.0, 4) AS total FROM events GROUP BY 1, 2",
    "stream_ack_counts": "SELECT 'b' || CAST(event_id % 700 AS VARCHAR) AS commit_id, count(DISTINCT user_id % 5) AS acks FROM events GROUP BY 1",
}

# The hash over bytes, in 128-bit arithmetic modulo 2^64; bytes of a text by its hexadecimal digits.
_NIBBLE = "(instr('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)"


def _bytes(text: str) -> str:
    h = f"hex(encode({text}))"
    return f"list_transform(range(1, strlen({text}) + 1), lambda i: 16 * {_NIBBLE.format(h=h, i='2 * i - 1')} + {_NIBBLE.format(h=h, i='2 * i')})"


def _fnv(raw: str, basis: int = 14695981039346656037) -> str:
    return f"list_reduce(list_prepend({basis}::UHUGEINT, list_transform({raw}, lambda b: b::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _little(n: str) -> str:
    """A number below 256 as 8 bytes."""
    return f"[{n}, 0, 0, 0, 0, 0, 0, 0]"


_ROUTING = 1469598103934665603
_RING = f"""points AS (SELECT s, {_fnv(_bytes("'shard:' || s::VARCHAR || ':vn:' || v::VARCHAR"), _ROUTING)} AS place FROM range(8) a(s), range(64) b(v)),
ring AS (SELECT list(s ORDER BY place) AS owners, list(place ORDER BY place) AS places FROM points)"""
_ROUTED = """turned AS (SELECT *, list_concat(owners[first:], owners[:first - 1]) AS turn FROM (SELECT *, CASE WHEN n = len(places) THEN 1 ELSE n + 1 END AS first FROM (SELECT h.*, ring.*, len(list_filter(places, lambda p: p < h.hash)) AS n FROM hashed h, ring)))"""


def _signatures(bits: int) -> str:
    """Bits of sign projections of the tenant's vectors and of the query's, by the planes' rule."""
    m, two = "4294967296::UHUGEINT", "::UHUGEINT"
    return f"""h0 AS (SELECT b, d, ((d + b * 64 + 1){two} * 2654435761) % {m} AS h FROM range({bits}) x(b), range(64) y(d)),
h1 AS (SELECT b, d, (xor(h, h >> 15) * 2246822519::UHUGEINT) % {m} AS h FROM h0),
h2 AS (SELECT b, d, (xor(h, h >> 13) * 3266489917::UHUGEINT) % {m} AS h FROM h1),
planes AS (SELECT b, list(CASE WHEN h >> 31 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane FROM h2 GROUP BY b),
mine AS (SELECT v.* FROM vectors v JOIN claims USING (claim_id) WHERE tenant_id = 'en'),
bits AS (SELECT claim_id, b, list_dot_product(vals, plane) > 0 AS bit FROM mine, planes),
asked AS (SELECT b, list_dot_product((SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {{vec}}), plane) > 0 AS bit FROM planes),
apart AS (SELECT claim_id, count(*) FILTER (bits.bit <> asked.bit) AS apart FROM bits JOIN asked USING (b) GROUP BY 1)"""


def _ann(vec: int, bits: int, budget: int, n: int) -> str:
    return f"""{_signatures(bits).format(vec=vec)},
reranked AS (SELECT claim_id, list_cosine_similarity(vals, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec})) AS cos FROM mine WHERE claim_id IN (SELECT claim_id FROM apart ORDER BY apart, claim_id LIMIT {budget})),
annfound AS (SELECT claim_id, cos FROM reranked ORDER BY cos DESC, claim_id LIMIT {n})"""


_BEST = "best AS (SELECT claim_id FROM (SELECT claim_id, list_cosine_similarity(vals, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cos FROM mine) ORDER BY cos DESC, claim_id LIMIT 100)"


def _batch_of(i: int, **given) -> str:
    return "SELECT * FROM (" + _retrieval(k=10, tail=f"SELECT CAST({i} AS BIGINT) AS query_id, row_number() OVER (ORDER BY score DESC, claim_id) AS rank, claim_id, round(score, 6) AS score FROM result", **given) + ")"


ORACLES |= {
    "hash_embeddings": f"""WITH words AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+'), lambda w: w <> '')) AS w FROM documents),
hashes AS (SELECT w, {_fnv(_bytes('w'))} AS h FROM (SELECT DISTINCT w FROM words)),
counts AS (SELECT doc_id, CAST(h % 64 AS BIGINT) AS "at", CAST(sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END) AS DOUBLE) AS x FROM words JOIN hashes USING (w) GROUP BY 1, 2),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM counts GROUP BY 1 HAVING sum(x * x) > 0)
SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS claim_id, "at", CAST(CAST(x / norm AS FLOAT) AS DOUBLE) AS x FROM counts JOIN lengths USING (doc_id) WHERE x <> 0
UNION ALL SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lengths)""",
    "payload_fingerprints": f"""WITH ids AS (SELECT doc_id // 100 AS "commit", 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id FROM documents),
raw AS (SELECT "commit", list_concat({_little('count(*)')}, {_little('count(*)')}, flatten(list(list_concat({_little('strlen(id)')}, {_bytes('id')}) ORDER BY id))) AS raw FROM ids GROUP BY 1)
SELECT "commit", lower(lpad(hex(CAST({_fnv('raw')} AS UBIGINT)), 16, '0')) AS fingerprint FROM raw""",
    "ring_route": f"""WITH {_RING},
keys AS (SELECT DISTINCT lang, source FROM documents),
hashed AS (SELECT lang, source, {_fnv(_bytes("lang || '|' || source"), _ROUTING)} AS hash, CAST({_fnv(_bytes("lang || source"), _ROUTING)} % 8 AS BIGINT) AS modulo FROM keys),
{_ROUTED},
runs AS (SELECT *, list_filter(turn, lambda s, i: i = 1 OR s <> turn[i - 1]) AS run FROM turned),
found AS (SELECT lang, source, modulo, list_concat([run[1]], list_filter(run[2:], lambda s: s <> run[1]))[1:3] AS shards FROM runs)
SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS claim_id, array_to_string(shards, ',') AS shards, modulo FROM documents JOIN found USING (lang, source)""",
    "write_admission": f"""WITH {_RING}, {_PLACEMENTS},
docs AS (SELECT 't' || CAST(doc_id % 5 AS VARCHAR) AS tenant_id, source, count(*) AS n FROM documents GROUP BY 1, 2),
hashed AS (SELECT tenant_id, source, n AS rows_, {_fnv(_bytes("tenant_id || '|' || source"), _ROUTING)} AS hash FROM docs),
{_ROUTED},
state AS (SELECT tenant_id, shard_id, count(*) AS replicas, count(*) FILTER (health = 'healthy') AS healthy, max(CASE WHEN role = 'leader' AND health = 'healthy' THEN node_id END) AS leader FROM p GROUP BY 1, 2)
SELECT CASE WHEN replicas IS NULL THEN 'no_placement' WHEN leader IS NULL THEN 'no_leader' WHEN healthy < 2 THEN 'too_few_replicas' WHEN leader <> 'node-1' THEN 'not_leader' ELSE 'accepted' END AS outcome, CAST(sum(rows_) AS BIGINT) AS n
FROM turned t LEFT JOIN state s ON s.tenant_id = t.tenant_id AND s.shard_id = t.turn[1] GROUP BY 1""",
    "ann_vector_topk": f"{TABLES}, {_ann(0, 256, 40, 10)} SELECT claim_id, round(cos, 6) AS cos FROM annfound",
    "recall_at_k": f"{TABLES}, {_ann(0, 1024, 1600, 100)}, {_BEST} SELECT count(*) AS exact, count(*) FILTER (claim_id IN (SELECT claim_id FROM annfound)) AS hits, round(count(*) FILTER (claim_id IN (SELECT claim_id FROM annfound)) / count(*), 6) AS recall FROM best",
    "retrieve_inverted_range": "SELECT '' AS claim_id, 0.0::DOUBLE AS score, 0::BIGINT AS supports, 0::BIGINT AS contradicts, 0.0::DOUBLE AS quality WHERE false",
    "retrieve_batch_filtered": "\nUNION ALL\n".join([
        _batch_of(0, time=True), _batch_of(1, tenant="de", tokens=("der", "die", "und"), entities=["src1", "src7"], support_only=True), _batch_of(2, tokens=("thou", "reshes"), time=True, support_only=True),
        _batch_of(3, tenant="fr", tokens=("le", "la", "zzzz"), entities=["src1", "src3"], embeddings=["emb-1", "emb-13", "emb-43"]),
    ]),
    "planner_debug": _retrieval(k=5, support_only=True, time=True, vector=0, tail=f"""SELECT (SELECT count(*) FROM own) AS tenant_claims, (SELECT count(*) FROM own WHERE list_has_any(toks, ['the', 'of', 'and'])) AS matched, (SELECT count(*) FROM own WHERE {_IN_RANGE}) AS allowed, (SELECT count(*) FROM cand) AS candidates,
(SELECT count(*) FROM near) AS vector_candidates, CAST(4 AS BIGINT) AS query_tokens, CAST(100 AS BIGINT) AS vector_limit, true AS semantic, true AS time_filter, false AS metadata_filter, false AS allowed_filter, false AS short_circuit, 'support_only' AS stance_mode"""),
    "validate_edges": "SELECT CASE o_orderkey % 10 WHEN 1 THEN 'strength' WHEN 2 THEN 'relation' WHEN 3 THEN 'to_claim_id' ELSE 'ok' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "document_payloads": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text END AS text FROM documents",
    "request_targets": "SELECT doc_id, lang AS tenant_id, 'a b+ ' || source AS query, '7' AS top_k, '' AS flag, CAST(NULL AS VARCHAR) AS bad FROM documents",
    "placement_file": f"WITH {_PLACEMENTS} SELECT tenant_id, shard_id, epoch, node_id, role, health FROM p",
    "segment_manifest": f"{_SEGMENTS}, h AS (SELECT tier, n, claim_id, {_fnv(_bytes('claim_id'))} AS h FROM segs) SELECT tier, tier || '-' || CAST(n AS VARCHAR) AS segment_id, count(*) AS n_claims, CAST(sum(CAST(h // 16 AS HUGEINT)) AS VARCHAR) AS checksum FROM h GROUP BY 1, 2",
    "checkpoint_replay": f"WITH {_LOG} SELECT claim_id, 't1' AS tenant_id, arg_max(body, ((\"offset\" % 4) // 2) * 1000000000 + \"offset\") AS canonical_text FROM log WHERE kind = 'C' GROUP BY claim_id",
    "mirror_cold_start": f"WITH {_LOG}, v AS (SELECT claim_id, arg_max(body, \"offset\") AS body, max(\"offset\") AS latest FROM log WHERE kind = 'V' GROUP BY 1), c AS (SELECT claim_id, arg_max(body, \"offset\") AS canonical_text, max(\"offset\") AS changed FROM log WHERE kind = 'C' GROUP BY 1) SELECT claim_id, canonical_text, CASE WHEN latest > changed THEN CAST(body AS DOUBLE) END AS first FROM c LEFT JOIN v USING (claim_id)",
}
_NEAR = f"""{_ann(3, 1024, 100, 100)},
near AS (SELECT claim_id FROM annfound)"""
ORACLES["retrieve_semantic_ann"] = _retrieval(tokens=("thou", "reshes"), vector=3)
_EXACT = ORACLES["retrieve_semantic_ann"].split("near AS (", 1)[1].split("),\ncand AS", 1)[0]
ORACLES["retrieve_semantic_ann"] = ORACLES["retrieve_semantic_ann"].replace(f"near AS ({_EXACT})", _NEAR)

ORACLES |= {
    "baseline_hybrid_top": f"{TABLES} SELECT claim_id, round({_OVERLAP}, 6) AS overlap FROM tokens JOIN claims USING (claim_id, tenant_id) WHERE tenant_id = 'en' AND lower(entity) IN ('src1', 'src3') AND embedding_id IN ('emb-1', 'emb-13', 'emb-43') ORDER BY overlap DESC, claim_id LIMIT 1",
    "api_answer": _retrieval(k=5, time=True, tail="SELECT 1").rsplit("SELECT 1", 1)[0] + f""", start AS (SELECT claim_id FROM result), depths AS (SELECT claim_id AS node, 0 AS depth FROM start), {_reasoning(1)}
SELECT r.claim_id, round(r.score, 6) AS score, round(r.quality, 6) AS quality, CASE WHEN r.supports + r.contradicts > 0 THEN round(r.contradicts / (r.supports + r.contradicts), 6) END AS risk, round(graph_score, 6) AS graph_score,
CAST(r.supports AS BIGINT) AS supports, CAST(r.contradicts AS BIGINT) AS contradicts, (SELECT count(*) FROM evidence e WHERE e.claim_id = r.claim_id) AS citations, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band,
CASE WHEN r.supports > r.contradicts THEN 'supports' WHEN r.contradicts > r.supports THEN 'contradicts' WHEN r.supports > 0 THEN 'balanced' END AS dominant,
CASE WHEN event_time_unix IS NOT NULL AND ({_HAS}) THEN 'event_and_validity_window' WHEN event_time_unix IS NOT NULL THEN 'event_time' WHEN {_HAS} THEN 'validity_window' ELSE 'no_temporal_data' END AS temporal_mode, {_IN_RANGE} AS in_range,
paths, depth, CASE WHEN confidence >= 0.3 THEN 'base' ELSE 'delta' END AS origin FROM result r JOIN own USING (claim_id) JOIN scores USING (claim_id)""",
    "span_coverage": f"WITH {_SENTENCE_PARTS}, kept_ AS (SELECT doc_id FROM ranked WHERE ordinal <= 32) SELECT count(*) AS n, count(*) FILTER (doc_id % 10 <> 0) AS covered, round(count(*) FILTER (doc_id % 10 <> 0) / count(*), 6) AS coverage FROM kept_",
    "parse_document_requests": """SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN 'inline ' || CAST(doc_id AS VARCHAR) WHEN 7 THEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)) END AS body,
CASE WHEN doc_id % 8 = 2 THEN 'inline_text' WHEN doc_id % 8 > 1 THEN 'builtin' END AS parser,
CASE doc_id % 8 WHEN 0 THEN 'mime_type is required' WHEN 1 THEN 'no parser for application/pdf' WHEN 3 THEN 'either text or content_base64 is required' WHEN 4 THEN 'content_base64 is not valid' WHEN 5 THEN 'document parser yielded empty text' WHEN 6 THEN 'payload is not valid UTF-8' END AS error FROM documents""",
}
