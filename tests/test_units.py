"""Single operators on small tables, with results worked out by hand or by a plain loop."""

import base64
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidenza.functions import ann, embeddings, hashing, text, vectors
from evidenza.operators import extraction, filters, graph, metrics, quality, ranking, routing, segments
from evidenza.plans.retrieve import Request, response, retrieve, vector_limit
from evidenza.schema import ConflictError, IntegrityError, StoreError, Tables
from evidenza.sources import changelog, wire
from evidenza.sources.mirror import Mirror, cold_start
from evidenza.streaming import replication

CLAIMS = "claim_id string, tenant_id string, canonical_text string, confidence double, event_time_unix long, entities array<string>, embedding_ids array<string>, valid_from long, valid_to long"
EVIDENCE = "evidence_id string, claim_id string, source_id string, stance string, source_quality double, seq long"
EDGES = "edge_id string, from_claim_id string, to_claim_id string, relation string, strength double"


def fnv(raw, state=hashing.BASIS):
    for b in raw:
        state = (state ^ b) * hashing.PRIME % (1 << 64)
    return state


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values))
    return rows.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        ("a1", "t", "Company X acquired Company Y in 2025", 0.9, 100, ["X"], ["e1"], None, None),
        ("a2", "t", "Company X and Company Z became partners", 0.7, None, ["x ", "Z"], ["e2"], 50, 150),
        ("a3", "t", "weather was fine", 0.5, None, ["W"], ["e1"], None, None),
        ("b1", "u", "Company X acquired Company Y in 2025", 0.9, 100, ["X"], ["e1"], None, None),
    ]
    evidence = [("v1", "a1", "s1", "supports", 0.9, 1), ("v2", "a1", "s2", "contradicts", 0.5, 2), ("v3", "a1", "s3", "contradicts", 0.7, 3), ("v4", "a2", "s1", "neutral", 0.4, 4)]
    edges = [("g1", "a1", "a2", "supports", 0.5), ("g2", "a2", "a3", "contradicts", 0.8), ("g3", "a3", "zz", "contradicts", 1.0)]
    vecs = [("a1", [1.0, 0.0]), ("a2", [0.6, 0.8]), ("b1", [1.0, 0.0])]
    return Tables(spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(edges, EDGES), spark.createDataFrame(vecs, "claim_id string, values array<float>"))


def test_text_functions(spark):
    assert one(spark, text.tokenize(F.col("t")), t=" Don't stop, the-Émile 42!! -- ") == ["dont", "stop", "themile", "42"]
    assert text.tokenize_text(" Don't stop, the-Émile 42!! -- ") == ["dont", "stop", "themile", "42"]
    assert one(spark, text.index_key(F.col("t")), t="  ÄbC\t") == "Äbc"
    assert one(spark, text.sanitize_id(F.col("t"), 8), t="--A b/c_D:e") == "a-b-c_"
    assert one(spark, text.sanitize_id(F.col("t"), 8), t="///") == "raw"
    assert one(spark, text.normalize_whitespace(F.col("t")), t=" a\t\nb  c ") == "a b c"
    odd = "a\\t\tb\\\n\\n"
    assert one(spark, text.unescape_field(text.escape_field(F.col("t"))), t=odd) == odd
    raw = b"any carnal pleas\xff\xfe"
    for encoded in (base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), " \n".join(base64.b64encode(raw).decode())):
        assert bytes(one(spark, text.decode_base64(F.col("t")), t=encoded)) == raw


def test_lists_round_trip(spark):
    rows = spark.createDataFrame([(["a:b", "é\n", ""],), ([],)], "v array<string>")
    assert [r[0] for r in rows.select(changelog.unpack_strings(text.pack_strings(F.col("v")))).collect()] == [["a:b", "é\n", ""], []]


def test_hashes(spark):
    words = ["", "a", "foobar", "é" * 40, "x" * 300]
    assert hashing.fnv1a([w.encode() for w in words]).tolist() == [fnv(w.encode()) for w in words]
    assert one(spark, hashing.fnv1a_hex("t"), t="foobar") == "85944171f73967e8"
    ids, le = ["c1", "é"], lambda n: n.to_bytes(8, "little")
    wanted = fnv(le(5) + le(2) + b"".join(le(len(i.encode())) + i.encode() for i in ids))
    assert spark.createDataFrame([(5, ids)], "n long, ids array<string>").select(hashing.payload_fingerprint("n", "ids")).first()[0] == f"{wanted:016x}"


def test_hash_embedding():
    for lower in (True, False):
        found = embeddings.HashProvider(16, lower).embed(["The the cat", "  ", "É x"])
        for words, vector in zip((["the", "the", "cat"] if lower else ["The", "the", "cat"], [], ["É", "x"]), found, strict=True):
            wanted = np.zeros(16)
            for w in words:
                h = fnv(w.encode())
                wanted[h % 16] += 1 if h >> 63 == 0 else -1
            if not wanted.any():
                wanted[0] = 1
            assert np.allclose(vector, wanted / np.linalg.norm(wanted), atol=1e-6)


def test_circuit_breaker():
    now = [0.0]
    breaker = embeddings.CircuitBreaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(embeddings.CircuitOpenError):
        breaker.call(lambda: 1)
    now[0] = 11
    assert breaker.state == "half_open" and breaker.call(lambda: 1) == 1 and breaker.state == "closed"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, None, None]


def test_retrieval_keeps_tenants_apart_and_ranks(tables):
    found = retrieve(tables, Request("t", "Company X acquired Company Y", 5)).collect()
    assert [r["claim_id"] for r in found] == ["a1", "a2"]
    assert (found[0]["supports"], found[0]["contradicts"]) == (2, 2)
    assert found[0]["overlap"] == 1.0 and abs(found[0]["quality"] - 0.7) < 1e-12


def test_retrieval_fallbacks_and_filters(tables):
    ids = lambda **k: [r["claim_id"] for r in retrieve(tables, Request(**({"tenant_id": "t", "query": "zzz"} | k))).collect()]
    assert sorted(ids()) == ["a1", "a2", "a3"]
    assert sorted(ids(query="!!!")) == ["a1", "a2", "a3"]
    assert ids(entities=["Z"]) == ["a2"] and ids(entities=[" X"], embedding_ids=["e2"]) == ["a2"]
    assert sorted(ids(time_from=150, time_to=200)) == ["a2"] and sorted(ids(time_from=100, time_to=100)) == ["a1", "a2"]
    assert ids(query="Company", top_k=1) == ids(query="Company")[:1]
    assert ids(tenant_id="nobody") == [] and ids(time_from=200, time_to=100) == []
    assert "a1" in ids(query="weather", query_vector=[1.0, 0.0])


def test_requests_are_checked():
    for bad in ({"top_k": 0}, {"stance_mode": "odd"}):
        with pytest.raises(StoreError):
            Request("t", "q", **bad).check()
    assert Request.from_query({"tenant_id": "t", "query": "q", "entity_filters": "a, b"}).entities == ["a", "b"]
    assert Request.from_json({"tenant_id": "t", "query": "q", "time_range": {"from_unix": 1}}).time_from == 1
    with pytest.raises(StoreError):
        Request.from_json({"tenant_id": "t", "query": " "})
    assert [vector_limit(k) for k in (1, 10, 1000)] == [100, 200, 5000]


def test_response_has_citations(tables):
    import json

    body = json.loads(response(tables, retrieve(tables, Request("t", "acquired", 1))).first()["json"])
    assert [c["evidence_id"] for c in body["citations"]] == ["v1", "v2", "v3"]


def test_validation(spark):
    rows = [("", "t", "x", 0.5, [], [], None, None), ("c", "t", "x", 1.5, [], [], None, None), ("c", "t", "x", 0.5, [" "], [], None, None), ("c", "t", "x", 0.5, None, None, 3, 2), ("c", "t", "x", 0.5, ["a"], [], 2, 2), ("c", "t", "x", None, [], [], None, None)]
    frame = spark.createDataFrame(rows, "claim_id string, tenant_id string, canonical_text string, confidence double, entities array<string>, embedding_ids array<string>, valid_from long, valid_to long")
    assert [r[0] for r in frame.select(filters.claim_error()).collect()] == ["claim_id", "confidence", "entities", "valid_window", None, "confidence"]
    good, bad = filters.split_valid(frame, filters.claim_error())
    assert good.count() == 1 and bad.count() == 5
    assert filters.durability_violations(257, 1, None, None, False) == ["sync_every_records", "batching_without_interval"]
    assert filters.durability_violations(1, 1, None, None, True) == ["background_without_flush"]


def test_graph(spark, tables):
    start = spark.createDataFrame([("a1",)], "claim_id string")
    assert {r["edge_id"] for r in graph.traverse(start, tables.edges, 2).collect()} == {"g1", "g2"}
    depth = {r["claim_id"]: r["depth"] for r in graph.contradiction_depth(start, tables.edges, 3).collect()}
    assert depth == {"a1": 0, "a2": 0, "a3": 1, "zz": 2}
    paths = {r["claim_id"]: r["paths"] for r in graph.support_paths(start, tables.edges, 3).collect()}
    assert paths == {"a1": 1, "a2": 1}
    incoming = {r["claim_id"]: round(r["incoming"], 6) for r in graph.incoming_weight(start, tables.edges).collect()}
    assert incoming == {"a2": 0.5, "a3": -0.6, "zz": -0.5625}
    nodes, edges = graph.evidence_graph(retrieve(tables, Request("t", "acquired", 1)), tables.claims.filter("tenant_id = 't'"), tables.edges)
    assert [r["claim_id"] for r in nodes.collect()] == ["a1", "a2", "a3"] and edges.count() == 3
    assert graph.GraphConfig.clamped(decay=4.0, max_hops=0).decay == 1.0


def test_segments(spark, tmp_path):
    claims = spark.createDataFrame([(f"c{i:03}", 0.9 if i % 2 else 0.1) for i in range(200)], "claim_id string, confidence double")
    built = segments.build(claims, 10)
    sizes = {(r["tier"], r["segment_id"]): r["n"] for r in built.groupBy("tier", "segment_id").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 20 and set(sizes.values()) == {10}
    merged = segments.compact(built).groupBy("segment_id").count().collect()
    assert {r["segment_id"]: r["count"] for r in merged}["hot-merged"] == 40 and len(merged) == 14
    store = segments.SegmentStore(spark, str(tmp_path / "segments"))
    with pytest.raises(IntegrityError):
        store.load()
    for _ in range(3):
        store.publish(built)
    assert store.load().count() == 200 and store.prune(1) == [1, 2] and store.published() == [3]


def test_log_round_trip(spark, tables, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    log.append(changelog.claim_lines(tables.claims))
    log.append(changelog.vector_lines(tables.vectors).union(changelog.evidence_lines(tables.evidence)).union(changelog.edge_lines(tables.edges)))
    again = spark.createDataFrame([("a1", "t", "new\ttext", 0.4, None, ["p\tq"], [], None, None)], CLAIMS)
    log.append(changelog.claim_lines(again.withColumn("entities", F.array(F.lit("pq")))))

    def state():
        records = changelog.decode(log.read())
        claims = {r["claim_id"]: (r["canonical_text"], r["entities"]) for r in changelog.claims(records).collect()}
        return claims, {r["claim_id"] for r in changelog.vectors(records).collect()}, changelog.evidence(records).count(), changelog.edges(records).count()

    before = state()
    assert before[0]["a1"] == ("new\ttext", ["pq"]) and before[1] == {"a2", "b1"} and before[2:] == (4, 3)
    assert log.checkpoint() == 1 and state() == before and log.boundary()["generation"] == 1
    log.append(changelog.edge_lines(tables.edges.limit(1)))
    assert state()[3] == 4
    assert changelog.window(log.read(), 2, 3).count() == 3 and changelog.needs_resync(log.read(), 999) and not changelog.needs_resync(log.read(), 1)
    with pytest.raises(Exception, match="invalid log record"):
        log.append(spark.createDataFrame([("Q\tx",)], "line string"))


def test_old_record_widths(spark):
    lines = [(0, "C\tc\tt\ttext\t0.5\tnull"), (1, "C\td\tt\ttext\t0.5\t7\t1:a\t"), (2, "E\te\tc\ts\tsupports\t0.5")]
    records = changelog.decode(spark.createDataFrame(lines, "offset long, line string"))
    rows = {r["claim_id"]: r for r in changelog.claims(records).collect()}
    assert rows["c"]["event_time_unix"] is None and rows["c"]["entities"] == [] and rows["d"]["entities"] == ["a"] and rows["d"]["event_time_unix"] == 7
    assert changelog.evidence(records).first()["chunk_id"] is None


def test_commits_are_idempotent(spark, tables, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    own = tables.claims.filter("tenant_id = 't'")
    send = lambda rows: changelog.ingest(log, "k1", rows)
    assert send(own) == "committed" and send(own) == "repeated"
    with pytest.raises(ConflictError):
        send(own.limit(1))
    with pytest.raises(StoreError):
        changelog.ingest(log, "k2", tables.claims)
    assert [r["commit_id"] for r in changelog.commit_ids(changelog.decode(log.read())).collect()] == ["k1"]


def test_ingest_is_all_or_nothing(spark, tables, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    own = tables.claims.filter("tenant_id = 't'")
    known = own.select("claim_id")
    evidence, edges = tables.evidence.join(known, "claim_id", "left_semi").drop("seq"), tables.edges.join(known.withColumnRenamed("claim_id", "from_claim_id"), "from_claim_id", "left_semi")
    bad = [
        {"claim_rows": own.withColumn("confidence", F.lit(2.0))}, {"evidence_rows": evidence.withColumn("stance", F.lit("odd"))}, {"evidence_rows": evidence.withColumn("claim_id", F.lit("nobody"))},
        {"edge_rows": edges.withColumn("strength", F.lit(-1.0))}, {"vector_rows": spark.createDataFrame([("a1", [])], "claim_id string, values array<float>")}, {"claim_rows": own.limit(0)}, {"most": 1},
    ]
    for given in bad:
        with pytest.raises(StoreError):
            changelog.ingest(log, "k", **({"claim_rows": own} | given))
    assert log.boundary()["records"] == 0

    def fails(rows):
        raise OSError("publishing failed")

    with pytest.raises(OSError):
        changelog.ingest(log, "k", own, evidence, edges, publish=fails)
    assert log.boundary()["records"] == 0
    assert changelog.ingest(log, "k", own, evidence, edges, tables.vectors.join(known, "claim_id", "left_semi")) == "committed"
    n = log.boundary()["records"]
    assert n == 1 + own.count() + evidence.count() + edges.count() + tables.vectors.join(known, "claim_id", "left_semi").count()
    with pytest.raises(ConflictError):  # the same claims, other evidence
        changelog.ingest(log, "k", own, evidence.limit(1))
    assert changelog.ingest(log, "k2", own.limit(1), policy=changelog.CheckpointPolicy(records=n)) == "committed" and log.generation() == 1
    assert not changelog.checkpoint_due(log, changelog.CheckpointPolicy(records=1, bytes=1)) and not changelog.checkpoint_due(log, changelog.CheckpointPolicy())
    log.snapshot_text(str(tmp_path / "text"))
    again = changelog.read_snapshot_text(spark, str(tmp_path / "text"))
    assert sorted(r["line"] for r in again.collect()) == sorted(r["line"] for r in log.read().collect())
    with pytest.raises(StoreError):
        changelog.read_snapshot_text(spark, str(tmp_path / "log/log/0"))


def test_followers_pull_and_resync(spark, tables, tmp_path):
    leader, follower = (changelog.ChangeLog(spark, str(tmp_path / x)) for x in ("leader", "follower"))
    lines = lambda log: sorted((r["offset"], r["line"]) for r in log.read().collect())
    leader.append(changelog.claim_lines(tables.claims))
    assert changelog.pull(follower, leader, "n1", 2) == {"node": "n1", "outcome": "delta", "next_offset": 2, "lag": tables.claims.count() - 2}
    while changelog.pull(follower, leader, "n1", 2)["outcome"] != "idle":
        pass
    assert lines(follower) == lines(leader)
    gap = spark.createDataFrame([(99, "G\te\ta\tb\tsupports\t0.5")], "offset long, line string")
    with pytest.raises(StoreError):
        changelog.apply_delta(follower, gap, 100)
    moved = leader.boundary()["next_offset"]
    with pytest.raises(Exception, match="changes its tenant"):
        changelog.apply_delta(follower, spark.createDataFrame([(moved, "C\ta1\tother\ttext\t0.5\tnull")], "offset long, line string"), moved + 1)
    assert lines(follower) == lines(leader)
    leader.checkpoint()
    leader.append(changelog.edge_lines(tables.edges))
    assert changelog.pull(follower, leader, "n1")["outcome"] == "resync" and lines(follower) == lines(leader)
    assert changelog.pull(follower, leader, "n1")["outcome"] == "idle"


def test_segment_sweep_and_prefilter(spark, tables, tmp_path):
    store = segments.SegmentStore(spark, str(tmp_path / "root/t1"))
    now = [0.0]
    seen = segments.SegmentPrefilter(store, 1.0, lambda: now[0])
    assert seen.ids() is None and seen.reason == "missing_manifest"
    for _ in range(4):
        store.publish(segments.build(tables.claims, 2))
    assert seen.ids() is None and seen.refreshes == 1
    now[0] = 2.0
    assert sorted(r[0] for r in seen.ids().collect()) == sorted(r[0] for r in tables.claims.select("claim_id").collect()) and seen.reason is None
    assert segments.maintain(spark, str(tmp_path / "root"), 3600) == {"t1": []}
    assert segments.maintain(spark, str(tmp_path / "root"), 0) == {"t1": [1, 2]} and store.published() == [3, 4]
    spark.createDataFrame([("hot", "hot-0", "stray")], "tier string, segment_id string, claim_id string").write.mode("append").partitionBy("tier").parquet(f"{store.root}/generation=4/segments")
    now[0] = 4.0
    assert seen.ids() is None and seen.reason == "invalid_segments"


def test_signatures_find_what_exact_search_finds(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32))
    rows = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("blank", []), ("short", [1.0])], "claim_id string, values array<double>")
    index, config = ann.indexed(rows), ann.AnnConfig()
    cos = x @ x[7] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[7])
    best = {f"c{i:04d}" for i in np.argsort(-cos)[:100]}
    found = ann.nearest(index, x[7].tolist(), 100, config).collect()
    assert found[0]["claim_id"] == "c0007" and len(found) == 100 and len(best & {f["claim_id"] for f in found}) >= 98
    assert [f["claim_id"] for f in ann.nearest(index, [2.0], 5).collect()] == ["short"]
    assert ann.nearest(index, [2.0, 1.0, 1.0], 5).count() == 0
    plain = rows.withColumn("signature", F.lit(None).cast("array<long>"))
    assert ann.nearest(plain, x[7].tolist(), 3).first()["claim_id"] == "c0007"  # nothing is indexed: compared exactly
    assert ann.AnnConfig(factor=2, least=10, most=50).budget(3) == 10 and ann.AnnConfig(factor=2, most=100).budget(90) == 100
    with pytest.raises(StoreError):
        ann.AnnConfig(bits=100)


def test_targets_and_escapes(spark):
    get = lambda t: one(spark, text.query_parameters(F.col("t")), t=t)
    assert get("/a?x=1&y=a%20b+c&x=2&flag&=v") == {"x": "2", "y": "a b c", "flag": "", "": "v"}
    assert get("/a") == {} and get("/a?q=%zz&ok=%C3%A9") == {"q": None, "ok": "é"}
    for raw in ("\ue000", "a\\tb", "\\\\n", "tab\t\\", "line\nfeed\\t\\", "", "\\"):
        assert one(spark, text.unescape_field(text.escape_field(F.col("t"))), t=raw) == raw
        assert one(spark, text.unescape_field(text.escape_field(F.col("t"), True)), t=raw + "\r") == raw + "\r"


def test_sliding_quantiles_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLIDE", 7)
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, r.random(), 0.5])) for i in range(200)]
    found = quality.sliding_quantile(spark.createDataFrame(rows, "i long, k string, v double"), "v", "i", "k", 0.95, 10).collect()
    for row in found:
        last = [v for i, k, v in rows if k == row["k"] and i <= row["i"]][-10:]
        held = sorted(v for v in last if v is not None)
        assert row["quantile"] == (held[int((len(held) - 1) * 0.95 + 0.5)] if held else None)
    assert len(found) == 200


def test_writes_are_admitted_by_the_local_leader(spark):
    rows = spark.createDataFrame([("c1", "t", ["x"]), ("c2", "t", ["x"]), ("c3", "u", [])], "claim_id string, tenant_id string, entities array<string>")
    place = lambda *r: spark.createDataFrame(list(r), routing.PLACEMENT)
    decide = lambda placements, policy="quorum": {r["claim_id"]: r["outcome"] for r in routing.local_writes(rows, placements, [0], "n1", policy).collect()}
    three = lambda a, b, c: place(("t", 0, 1, "n1", "leader", a), ("t", 0, 1, "n2", "follower", b), ("t", 0, 1, "n3", "follower", c))
    assert decide(three("healthy", "healthy", "degraded")) == {"c1": "accepted", "c2": "accepted", "c3": "no_placement"}
    assert decide(three("healthy", "degraded", "degraded"))["c1"] == "too_few_replicas" and decide(three("healthy", "degraded", "degraded"), "one")["c1"] == "accepted"
    assert decide(three("degraded", "healthy", "healthy"))["c1"] == "no_leader"
    assert decide(place(("t", 0, 1, "n2", "leader", "healthy")))["c1"] == "not_leader"
    assert routing.claim_placements(rows, three("healthy", "healthy", "healthy"), [0]).count() == 6
    with pytest.raises(StoreError):
        routing.placements_from(spark, None)


def test_parsers_and_embeddings_by_command(spark):
    b64 = lambda raw: base64.b64encode(raw).decode()
    rows = [(1, "application/pdf", None, b64(b"abc")), (2, "image/x", None, b64(b"fail")), (3, "text/plain", None, b64("é ".encode())), (4, "text/plain", None, b64(b"\xff\xfe")), (5, "application/pdf", " given ", "%%"), (6, None, "x", None), (7, "application/pdf", None, b64(b" "))]
    frame = spark.createDataFrame(rows, "id long, mime_type string, text string, content_base64 string")
    command = 'read x; if [ "$x" = fail ]; then echo no >&2; exit 3; fi; [ -n "$x" ] && echo "$DOCUMENT_MIME_TYPE $x"; true'
    found = {r["id"]: (r["body"], r["parser"], r["error"]) for r in extraction.parse_documents(frame, command).collect()}
    assert found[1] == ("application/pdf abc", "command", None) and found[3] == ("é", "builtin", None) and found[5] == ("given", "inline_text", None)
    assert found[2][0] is None and found[2][2] == "command exited with status 3: no"
    assert found[4][2] == "payload is not valid UTF-8" and found[6][2] == "mime_type is required" and found[7][2] == "document parser yielded empty text"
    provider = embeddings.CommandProvider("wc -c | tr -d ' ' | sed 's/.*/[&, 0.5]/'", 2)
    assert provider.embed(["abc", ""]) == [[3.0, 0.5], [0.0, 0.5]]
    for printed in ("", "[]", "[a]", "[1e99]"):
        with pytest.raises(StoreError):
            embeddings.CommandProvider.parse(printed)
    with pytest.raises(StoreError):
        embeddings.CommandProvider("exit 1").embed(["x"])


def test_follower_stream(spark, tables, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("source", "target", "check"))
    lines = changelog.numbered(changelog.claim_lines(tables.claims), 0, "line")
    lines.write.parquet(source)
    replication.follow(spark, source, target, check).awaitTermination()
    changelog.numbered(changelog.edge_lines(tables.edges), 4, "line").write.mode("append").parquet(source)
    replication.follow(spark, source, target, check).awaitTermination()
    found = replication.follower_log(spark, target)
    assert sorted(r["offset"] for r in found.collect()) == list(range(7))


def test_sentences(spark):
    raw = "  Erste Zeile mit Ümlaut.\nkurz.  Another sentence\twith  spaces here! "
    rows = extraction.sentences(spark.createDataFrame([(1, raw), (2, None), (3, "")], "doc_id long, text string"), 10).collect()
    assert [(r["doc_id"], r["ordinal"], r["sentence"]) for r in rows] == [(1, 1, "Erste Zeile mit Ümlaut"), (1, 2, "Another sentence with spaces here")]
    data = raw.encode()
    assert data[rows[0]["span_start"] : rows[0]["span_end"] + 1].decode() == "Erste Zeile mit Ümlaut"
    assert data[rows[1]["span_start"] : rows[1]["span_end"] + 1].decode() == "Another sentence\twith  spaces here"


def test_document_payloads(spark):
    rows = spark.createDataFrame([("text/plain; charset=utf-8", base64.b64encode(b"hi").decode()), ("image/png", "aGk=")], "mime string, body string")
    assert [r[0] for r in rows.select(extraction.document_text(F.col("mime"), F.col("body"))).collect()] == ["hi", None]
    lines = extraction.by_command(spark.createDataFrame([(1, "a\nb"), (2, "")], "i long, text string"), ["cat"])
    assert [(r["i"], r["line"]) for r in lines.orderBy("i", "line").collect()] == [(1, "a"), (1, "b")]


def test_ring_routes(spark):
    positions = {}
    for s in range(4):
        for v in range(64):
            positions[fnv(f"shard:{s}:vn:{v}".encode(), hashing.ROUTING_BASIS)] = s
    ordered = sorted(positions)
    rows = spark.createDataFrame([("t", f"k{i}") for i in range(30)], "t string, k string")
    for r in rows.withColumn("s", routing.shards_by_ring(F.col("t"), F.col("k"), [0, 1, 2, 3], 2)).withColumn("m", routing.shard_by_modulo(F.col("t"), F.col("k"), 5)).collect():
        h = fnv(f"t|{r['k']}".encode(), hashing.ROUTING_BASIS)
        turn = [positions[p] for p in ordered if p >= h] + [positions[p] for p in ordered if p < h]
        turn = [s for i, s in enumerate(turn) if not i or s != turn[i - 1]]
        assert r["s"] == [turn[0], *[s for s in turn if s != turn[0]]][:2]
        assert r["m"] == fnv(f"t{r['k']}".encode(), hashing.ROUTING_BASIS) % 5


def test_placements(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("# a comment\n t , 0, 3, n1, leader, degraded\nt,0,3,n2,follower,healthy\n\nt,1,1,n1,leader,healthy\n")
    rows = routing.read_placements(spark, str(file))
    assert rows.count() == 3 and [r["shard_id"] for r in routing.shard_ids(rows).collect()] == [0, 1]
    rows = rows.withColumn("position", F.regexp_extract("node_id", "([0-9]+)", 1).cast("long"))
    assert [r["shard_id"] for r in routing.write_routes(rows).collect()] == [1]
    assert {r["shard_id"]: r["node_id"] for r in routing.read_routes(rows, "prefer_follower").collect()} == {0: "n2", 1: "n1"}
    assert {r["shard_id"]: r["node_id"] for r in routing.read_routes(rows, "leader_only").collect()} == {0: "n1", 1: "n1"}
    promoted = {(r["shard_id"], r["node_id"]): (r["epoch"], r["role"]) for r in routing.promote(rows, "n2").collect()}
    assert promoted == {(0, "n1"): (4, "follower"), (0, "n2"): (4, "leader"), (1, "n1"): (1, "leader")}
    with pytest.raises(ConflictError):
        routing.replace_monotonic(routing.promote(rows, "n2"), rows)
    for bad in ("t,0,3,n1,leader\n", "t,0,3,n1,boss,healthy\n", "t,0,1,a,leader,healthy\nt,0,2,b,follower,healthy\n", "t,0,1,a,leader,healthy\nt,0,1,a,follower,healthy\n"):
        file.write_text(bad)
        with pytest.raises(StoreError):
            routing.read_placements(spark, str(file))


def test_quality(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "claim_id string")
    assert quality.recall(ids("a", "b"), ids("a", "c")).first()["recall"] == 0.5
    assert quality.f1(ids("a", "b"), ids("a", "c", "d")).first()["f1"] == pytest.approx(0.4)
    values = [random.Random(1).random() for _ in range(501)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    for q in (0.0, 0.5, 0.95, 1.0):
        assert quality.nearest_rank(frame, "v", q).first()[0] == sorted(values)[round(500 * q)]


def test_audit_chain(spark):
    events = spark.createDataFrame([("s", i, f"e{i}") for i in range(6)], "k string, i long, p string")
    chain = quality.chain(events, "i", F.col("p"), "k")
    assert quality.verify_chain(chain, "k").filter("fault is not null").count() == 0
    faults = {r["seq"]: r["fault"] for r in quality.verify_chain(chain.withColumn("hash", F.when(F.col("seq") == 3, F.lit("0" * 64)).otherwise(F.col("hash"))), "k").filter("fault is not null").collect()}
    assert faults == {3: "hash", 4: "prev_hash"}


def test_scores_are_finite(spark):
    rows = ranking.with_tokens(spark.createDataFrame([("a", ""), ("b", "x"), ("c", "X, y -- x!"), ("d", " -- ")], "id string, canonical_text string"))
    assert [r["n_tokens"] for r in rows.orderBy("id").collect()] == [0, 1, 3, 0]
    stats = ranking.corpus_stats(rows, ["x", "q"])
    assert stats.first()["df_0"] == 2 and stats.first()["n_matched"] == 2
    found = rows.crossJoin(stats).select("id", ranking.bm25(["x", "q", "x"]).alias("s")).toPandas()
    assert np.isfinite(found["s"]).all() and float(found.set_index("id")["s"]["a"]) == 0.0
    assert isinstance(found, pd.DataFrame)


def test_mirror_and_cold_start(spark, tables, tmp_path):
    mirror = Mirror(spark, str(tmp_path / "mirror"))
    with pytest.raises(IntegrityError):
        mirror.load()
    assert mirror.checkpoint(tables, 10) == 1 and mirror.meta() == {"high_water": 10, "claims": 4, "evidence": 4, "edges": 3, "vectors": 3}
    assert mirror.claim("a2").count() == 1 and {r["tenant_id"]: r["dimensions"] for r in mirror.tenant_dimension().collect()} == {"t": 2, "u": 2}
    log = spark.createDataFrame([(9, "C\ta3\tt\told\t0.1\tnull"), (10, "C\ta1\tt\tnew\t0.1\tnull"), (11, "V\ta3\t1.0,2.0"), (12, "E\tv9\ta1\ts\tneutral\t0.5")], "offset long, line string")
    state = cold_start(mirror, log)
    assert {r["claim_id"]: r["canonical_text"] for r in state.claims.collect()}["a1"] == "new" and state.claims.count() == 4
    assert {r["claim_id"] for r in state.vectors.collect()} == {"a2", "b1", "a3"} and state.evidence.count() == 5


def test_wire_batches(spark):
    body = '{"claim":{"claim_id":"c","tenant_id":"%s","canonical_text":"x","confidence":0.5}}'
    rows = wire.parse(spark.createDataFrame([(body % "t",), (body % "u",)], "body string"))
    wire.check_batch(rows.limit(1))
    for bad in (rows, rows.limit(0)):
        with pytest.raises(StoreError):
            wire.check_batch(bad)


def test_exposition(spark, tables):
    lines = [r["line"] for r in metrics.exposition(metrics.health(tables)).collect()]
    assert 'evidenza_claims{tenant="t"} 3.0' in lines and 'evidenza_tier_hot{tenant="u"} 1.0' in lines


def test_hash_embedding_memory():
    import tracemalloc

    texts = [" ".join(f"Wort{i * 7 % 997}é{j % 5}" for j in range(400)) for i in range(1000)] + [" x\x1cY　z" * 100_000, None, " "]
    whole, pieces = hashing.hash_embedding(16, True, 1 << 30).func, hashing.hash_embedding(16, True).func
    assert np.array_equal(np.stack(whole(pd.Series(texts[::50] + texts[-3:], dtype=object))), np.stack(hashing.hash_embedding(16, True, 5).func(pd.Series(texts[::50] + texts[-3:], dtype=object))))
    series = pd.Series(texts, dtype=object)
    tracemalloc.start()
    pieces(series)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # tokens of all texts at once take several times as much
