"""The n-gram join, the two vector operators, components and the pipeline, against brute force and on odd rows."""

import collections
import os
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidenza.llm import collision_counts, ngram_join, permutation_index
from evidenza.llm.common import Scratch
from evidenza.llm.components import components
from evidenza.llm.queries import QUERIES


def parts(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def word_sets(texts, n):
    lower, out = {i: i + 32 for i in range(65, 91)}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def near(sets, percent):
    posted, links = collections.defaultdict(list), []
    for i in sorted(sets):
        met = collections.Counter(j for s in sets[i] for j in posted[s])
        links += [(j, i) for j, k in met.items() if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k)]
        for s in sets[i]:
            posted[s].append(i)
    return links


def test_ngram_join(spark, data):
    found = QUERIES["op1_ngram_join"](spark, data).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sets = word_sets(texts, 4)
    assert found.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert found.component_id.to_dict() == parts(texts, near(sets, 85))


def test_ngram_join_of_clusters_and_odd_rows(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = {0: "", 1: None, 2: "one", 3: "One", 4: "two words", 5: " \t\n"}
    for i in range(6, 90):  # near copies, more or less changed
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        texts[i] = " ".join(words)
    for i in range(90, 110):  # a shared passage in texts of their own
        texts[i] = " ".join([f"y{r.randint(0, 10**6)}" for _ in range(80)] + base[:30])
    texts[110] = "long " * 50_000
    texts[111] = "long " * 50_001
    rows = [*texts.items(), (6, texts[6]), (None, base[0])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    found = ngram_join.ngram_join(frame, 4, 85, 12).toPandas()
    assert len(found) == len(rows) and found[found.doc_id.isna()].component_id.isna().all()
    named = found.dropna(subset=["doc_id"]).drop_duplicates().set_index("doc_id")
    sets = word_sets(texts, 4)
    assert named.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert named.component_id.to_dict() == parts(texts, near(sets, 85))
    assert ngram_join.ngram_join(frame.limit(0), 4, 85, 12).count() == 0


def test_ngram_join_of_groups_whose_leader_is_far(spark):
    """Chains a1, a2, b: where a1 and a2 have one prefix, b is near a2 alone, which does not lead the group."""
    r = random.Random(8)
    fresh = lambda: f"z{r.randint(0, 10**9)}"
    texts = {}

    def edited(words, places):
        return [fresh() if i in places else w for i, w in enumerate(words)]

    for i in range(0, 240, 3):
        a1 = [fresh() for _ in range(203)]
        a2 = edited(a1, {100})
        texts |= {i + k: " ".join(w) for k, w in enumerate((a1, a2, edited(a2, {20, 60, 140, 180})))}
    texts |= {i: " ".join(fresh() for _ in range(4000)) for i in range(300, 330)}  # these fill the sketch: the order is by hash
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = ngram_join.ngram_join(frame, 4, 85, 10).toPandas().set_index("doc_id")
    assert found.component_id.to_dict() == parts(texts, near(word_sets(texts, 4), 85))


def shuffles(spark):
    """Ids of the shuffles that have files."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {x.split("_")[1] for x in names if x.startswith("shuffle_")}


def test_scratch_leaves_no_shuffle_files(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(conf, None), shuffles(spark)
    frame = spark.range(10_000).withColumn("k", F.col("id") % 100).groupBy("k").count()
    saved = Scratch(spark, "test").save(frame)
    end = time.time() + 20
    while (left := shuffles(spark) - before) and time.time() < end:  # they go in the background
        time.sleep(0.1)
    assert not left and saved.count() == frame.count() == 100 and spark.conf.get(conf, None) == was


def test_ngram_join_leaves_little_on_disk(spark, data):
    """When its steps have run, neither their shuffle files nor tables with prefixes or whole sets stand."""
    docs, before = spark.read.parquet(f"{data}/documents.parquet"), shuffles(spark)
    join = ngram_join.NgramJoin(docs, 4, 85, 12)
    join.run()
    end = time.time() + 20
    while len(left := shuffles(spark) - before) > 4 and time.time() < end:
        time.sleep(0.1)
    assert len(left) <= 4  # a stage that Spark finds it need not wait for may end after its query
    root = join.scratch.root.removeprefix("file:")
    columns = {c for k in os.listdir(root) for c in spark.read.parquet(f"{root}/{k}").columns}
    assert "s1" in columns and not columns & {"prefix", "keys"}


def test_ngram_join_of_long_texts_with_a_common_passage(spark, monkeypatch):
    """Bitmaps say nothing of long texts; pairs with few common elements in their prefixes never meet whole prefixes."""
    r = random.Random(10)
    fresh = lambda k: [f"z{r.randint(0, 10**9)}" for _ in range(k)]
    passage = fresh(60)
    texts = {i: " ".join(fresh(1500) + passage) for i in range(60)}
    texts |= {60 + i: " ".join([*fresh(3), texts[i], *fresh(i)]) for i in range(5)}
    met, plain = [], ngram_join.NgramJoin.prefix_filter

    def counted(self, pairs, *rest):
        met.append(pairs.count())
        return plain(self, pairs, *rest)

    monkeypatch.setattr(ngram_join.NgramJoin, "prefix_filter", counted)
    found = ngram_join.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85, 10).toPandas().set_index("doc_id")
    assert found.component_id.to_dict() == parts(texts, near(word_sets(texts, 4), 85))
    assert met[-1] <= 20


def test_ngram_join_of_a_large_cluster(spark):
    """5,000 near copies whose rarest words all differ, beside clusters and texts of their own with the same words in their prefixes; chains are short."""
    r = random.Random(9)
    fresh = lambda: f"z{r.randint(0, 10**9)}"
    base = [fresh() for _ in range(60)]
    texts = {i: " ".join(base[:30] + [fresh()] + base[31:]) for i in range(5000)}
    for i in range(5000, 5300, 3):
        own = base[:14] + [fresh() for _ in range(12)]
        texts |= {i: " ".join(own), i + 1: " ".join([*own, fresh()]), i + 2: " ".join([fresh(), *own])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = ngram_join.ngram_join(frame, 4, 85, 10, 4).toPandas().set_index("doc_id").sort_index()
    sets = word_sets(texts, 4)
    assert (found.component_id[:5000] == 0).all()
    few = {i: s for i, s in sets.items() if i == 0 or i >= 5000}
    assert found.component_id[found.index.isin(few)].to_dict() == parts(few, near(few, 85))


def test_word_hashes_do_not_depend_on_place():
    texts = ["a b  c", "", "c\tB\x0ba", "é日 x"]
    alone = [np.concatenate(list(ngram_join.word_hashes([t]))) for t in texts]
    assert all((a == b).all() for a, b in zip(alone, ngram_join.word_hashes(texts), strict=True))
    assert (alone[0] == alone[2][::-1]).all() and len(alone[1]) == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    assert len(np.unique(next(ngram_join.word_hashes([long])))) == 400_000


def test_filters_never_lose_a_similar_pair():
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 1 << 60, n).astype("u8"))
        b = a.copy()
        b[r.random(len(b)) < 0.1] = r.integers(0, 1 << 60, 1)[0]
        b = np.unique(np.concatenate([b, r.integers(0, 1 << 60, int(r.integers(0, 8))).astype("u8")]))
        if ngram_join.similar(a, b, 85):
            pa, pb = (x[: ngram_join.prefix_size(len(x), 85)] for x in (a, b))
            assert ngram_join.prefixes_allow(pa, len(a), pb, len(b), 85)
            assert np.intersect1d(pa, pb).size
            bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.bitmap(a) ^ ngram_join.bitmap(b))
            assert bits * 185 <= (len(a) + len(b)) * 15


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_components(spark, block):
    """In one block, and in many with rounds of stars between them."""
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)] + [(7, 7)]
    found = components(spark.createDataFrame([*edges, (None, 4), (4, None)], "u long, v long"), Scratch(spark, "test"), block).collect()
    ids = {x for e in edges for x in e}
    assert {r["node"]: r["component"] for r in found} == {i: c for i, c in parts(ids, edges).items() if i != c}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), block).count() == 0


def vectors_of(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    return rows, np.array(rows.embedding.tolist(), "f8")


def test_permutation_index(spark):
    rows, x = vectors_of(spark, "/root/testdata/sf0.1")
    found = QUERIES["op2_permutation_index"](spark, "/root/testdata/sf0.1").toPandas().sort_values(["query_id", "rank"])
    ids, hits, queries = rows.vec_id.to_numpy(), 0, [i for i in rows.vec_id if i % 20 == 0]
    assert sorted(found.query_id.unique()) == queries
    for q, own in found.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        best = np.lexsort((ids, -score))[:20]
        hits += len(set(own.vec_id) & set(ids[best]))
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [x[ids == v][0] @ x[ids == q][0] for v in own.vec_id], atol=1e-12)
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(own.score, own.score[1:], own.vec_id, own.vec_id[1:], strict=False))
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize("n, hot", [(3000, 0), (8192, 0), (8192, 2730), (8192, 5734), (24576, 0), (24576, 8192)])
def test_recall_of_the_permutation_index(spark, n, hot, monkeypatch):
    """Isotropic vectors, the hardest case; some are noisy copies of one vector. The share of rows that queries rank falls with their number."""
    monkeypatch.setattr(permutation_index, "ROWS_PER_SHARD", 4096)
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:hot] = x[0] + 0.05 * r.normal(size=(hot, 64))
    x, ids = x[r.permutation(len(x))], np.arange(len(x))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    found = permutation_index.nearest_neighbours(frame, frame.filter("vec_id % 100 = 0"), block=4096, group=100).toPandas()
    hits, queries = 0, ids[ids % 100 == 0]
    for q, own in found.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(own.vec_id) & set(np.lexsort((ids, -score))[:20].tolist()))
        assert len(own) == own.vec_id.nunique() == 20
    recall = hits / (20 * len(queries))
    index = permutation_index.fit(frame.select("vec_id", F.size("embedding").alias("size"), F.col("embedding").alias("vector")))[64]
    rows, asked, ranked = index.orders(x, permutation_index.POSTED, False), index.orders(x[queries], min(permutation_index.ASKED, len(index.at)), True), 0
    for shard in np.unique(index.shard):
        files = permutation_index.Files(rows, index.shard, shard)
        ranked += sum(len(files.near(o)[0]) for o in asked)
    print(f"{n} rows, {hot} hot: recall {recall:.3f}, met {ranked / n / len(queries):.3f} of the rows, {len(index.at)} pivots in {index.shard.max() + 1} shards")
    assert recall >= 0.9 and (n < 20_000 or ranked < 0.7 * n * len(queries))


def test_permutation_index_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [5.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, -2.0]), (40, None), (2, [1.0, 0.0]), (20, [0.0, -2.0]), (60, [1e200, 0.0, 1e200, 1.0]), (80, [1.0, 1.0, 1.0, 1.0]), (100, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    found = permutation_index.nearest_neighbours(frame, frame.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 5.0), (0, 2, 1.0), (0, 2, 1.0), (0, 20, 0.0), (0, 20, 0.0), (20, 0, 0.0), (20, 2, 0.0), (20, 2, 0.0), (20, 1, -2.0), (60, 80, 2e200), (80, 60, 2e200)]
    assert permutation_index.nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0
    assert permutation_index.nearest_neighbours(frame, frame.filter("vec_id = 40")).count() == 0


def test_footrule():
    r = np.random.default_rng(4)
    shard_of = r.integers(0, 3, 30)
    order = np.array([r.permutation(30)[:5] for _ in range(40)])
    query = r.permutation(30)[:10]
    place = lambda o: {int(p): i for i, p in enumerate(o)}
    want = {i: sum(abs(j - place(query).get(int(p), 10)) for j, p in enumerate(o)) for i, o in enumerate(order) if set(o) & set(query)}
    found = {}
    for shard in range(3):
        rows, far = permutation_index.Files(order, shard_of, shard).near(query)
        assert not found.keys() & set(rows)  # each row is one shard's alone
        found |= dict(zip(rows, far, strict=True))
    assert found == want


def test_permutations():
    r = np.random.default_rng(5)
    x, pivots = r.normal(size=(50, 6)), permutation_index.choose_pivots(r.normal(size=(40, 6)))
    whole = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    assert all((permutation_index.permutations(x, pivots, n) == whole[:, :n]).all() for n in (1, 7, len(pivots), len(pivots) + 3))
    copies = np.repeat(r.normal(size=(3, 6)), 10, 0) * r.uniform(1, 5, (30, 1))
    assert len(permutation_index.choose_pivots(copies)) == 3


def linked(labels, vectors, cosine=0.98):
    out = []
    for i in range(len(labels)):
        for j in range(i + 1, len(labels)):
            if labels[i] is not None and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], "f8"), np.array(vectors[j], "f8")
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    out.append((i, j))
    return out


def test_collision_counts(spark, data):
    rows, x = vectors_of(spark, data)
    found = QUERIES["op3_collision_counts"](spark, data).toPandas().set_index("vec_id").sort_index()
    links = linked(list(rows.label), list(x))
    degree = collections.Counter(i for pair in links for i in pair)
    ids = rows.vec_id.tolist()
    assert found.n_links.tolist() == [degree[i] for i in range(len(ids))]
    assert found.component_id.to_dict() == parts(ids, [(ids[a], ids[b]) for a, b in links])
    assert (found.kept == (found.index == found.component_id)).all()


@pytest.mark.parametrize("size", [40, 2600])
def test_collision_counts_of_a_large_cluster(spark, size, monkeypatch):
    monkeypatch.setattr(collision_counts, "BLOCK", 700)
    r = np.random.default_rng(5)
    near_one = r.normal(size=16) + 0.02 * r.normal(size=(size, 16))
    apart = r.normal(size=(300, 16))
    copies = np.repeat(r.normal(size=(1, 16)), 50, 0)
    x = np.concatenate([near_one, apart, copies]).astype("f4")
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    found = collision_counts.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    assert (found.n_links.to_numpy() == hit.sum(1)).mean() > 0.999
    assert (found.component_id[:size] == 0).all() and (found.component_id[-50:] == size + 300).all() and (found.n_links[-50:] == 49).all()


def test_collision_counts_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 2, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0]), (6, 1, [nan, 1.0]), (7, 1, [1.0, None]), (8, 1, [1.0, 0.0]), (9, 1, [1.0, 0.0, 0.0]), (8, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0, 0.01])]
    frame = spark.createDataFrame([(i, lab, v, 0) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, n_links int")
    found = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collision_counts.near_duplicates(frame).collect()]
    want = [(0, 3, 0, True), (1, 3, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 3, 0, False), (8, 3, 0, False), (9, 1, 9, True), (10, 1, 9, False), (None, 0, None, None)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert collision_counts.near_duplicates(frame.limit(0)).count() == 0


def test_the_count_is_calibrated():
    r = np.random.default_rng(6)
    lines = collision_counts.Lines.calibrated(0.98, 5000)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * side
    lines.fit(a)
    pa, pb = lines.project(a), lines.project(b)
    near = np.abs(pa - pb) <= lines.window
    n = lines.sorted_lines
    assert (near[:, n : n + 8].sum(1) >= lines.least[0]).all() and (near[:, n:].sum(1) >= lines.least[1]).all()
    assert near[:, :n].reshape(-1, lines.tables, lines.per_table).all(2).any(1).mean() > 0.999
    strangers = np.abs(pa[:-1] - pa[1:])[:, n:] <= lines.window
    assert (strangers.sum(1) >= lines.least[1]).mean() < 0.001


def test_pairs_within_the_windows_meet_in_one_place():
    r = np.random.default_rng(7)
    lines = collision_counts.Lines.calibrated(0.98, 9000)
    x = r.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lines.fit(x)
    projected, met = lines.project(x), collections.Counter()
    stands = collections.defaultdict(list)
    for i, t, place, guest in zip(*lines.places(x), strict=True):
        stands[t, place].append((i, guest))
    for (t, _), members in stands.items():
        met.update((t, min(i, j), max(i, j)) for k, (i, g) in enumerate(members) for j, h in members[k + 1 :] if not g & h)
    for t in range(lines.tables):
        own = projected[:, t * lines.per_table : (t + 1) * lines.per_table]
        for i in range(len(x)):
            for j in np.flatnonzero((np.abs(own[i] - own) <= lines.window).all(1)):
                assert i >= j or met[t, i, j] == 1
    assert lines.per_table > 2 and max(met.values()) == 1


def test_pipeline_keeps_different_texts_of_one_id(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    r = random.Random(11)
    text = lambda: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(60))
    rows = []
    for i in range(0, 80, 2):  # i and i + 1 share a text; i + 1 has one of its own as well, twice
        shared, own = text(), text()
        rows += [(i, shared), (i + 1, shared), (i + 1, own), (i + 1, own), (None, own)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = sorted((r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, frame, data).filter("doc_id is not null").collect())
    assert kept == sorted({(i, t) for i, t in rows if i is not None} - {(i, t) for i, t in rows if i is not None and (i - 1, t) in rows})


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, texts = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = Scratch(spark, "test").save(stage(spark, kept, data))
        assert kept.columns == docs.columns, name
        texts[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts["language_id"]) == {i for i, t in every.items() if re.search(r"[^\W\d_]", t or "")}
    sets = word_sets(texts["language_id"], 5)
    assert set(texts["ngram_join"]) == {i for i, c in parts(sets, near(sets, 80)).items() if i == c}
    assert not any("@mail" in t for t in texts["pii"].values())
    packed = pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts["pii"])
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "the of and", "en", "s", 1), (3, "the of and", None, "s", 1), (4, "die und der das", "de", "s", 1), (5, "is of and the", "en", "s", 1)], docs.schema)
    for _, stage in pipeline.STAGES[:-1]:
        odd = Scratch(spark, "test").save(stage(spark, odd, data))
    assert sorted(str(r["doc_id"]) for r in odd.collect()) == ["3", "4", "5", "None"] and odd.filter(F.col("lang").isNull()).count() == 0
    assert pipeline.pack_sequences(spark, odd.limit(0), data).count() == 0
