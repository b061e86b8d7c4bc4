"""BM25, index figures, fusion, vectors, evaluation: literal values and small brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findery.config import BM25Params, RankFusion, checked_limit
from findery.functions.analysis import terms
from findery.operators import best, bm25, knn
from findery.operators.evaluation import best_parameters, by_category, losses, per_query, summary, swept
from findery.operators.fusion import reciprocal_rank_fusion
from findery.operators.index import InvertedIndex, Matches, build_index, contains, corpus_stats, index_stats, match, matching, merge_stats
from findery.operators.sharding import cluster_stats, merged_topk, shard_stats

#: Lengths, repeats and ties that differ; ids that sort otherwise as numbers.
CORPUS = {
    "r-1": "harbour harbour harbour tide chart",
    "r-2": "a pilot reads the tide table before leaving a harbour for another harbour",
    "r-3": "quiet harbour",
    "r-4": "ropes fenders and lights were moved to the outer quay last winter",
    "r-5": "a chart shows depths and rocks",
    "r-6": "tide and wind set the hour of sailing",
    "r-12": "the lamp on the pier is out",
    "r-13": "harbour",
}
QUERIES = ["harbour", "tide", "harbour tide", "chart depths", "harbour harbour", "pilot table", "zeppelin"]


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, text string")


def scores(spark, texts, query, params=BM25Params(), **more):
    asked = bm25.query_terms(spark, {0: query})
    return {r["document_id"]: r["score"] for r in bm25.score(build_index(corpus(spark, texts)), asked, params, **more).collect()}


def brute(texts, query, k1=1.2, b=0.75):
    tokens = {i: terms(t) for i, t in texts.items()}
    n, total = len(tokens), sum(map(len, tokens.values()))
    out = {}
    for t in terms(query):
        df = sum(t in x for x in tokens.values())
        for i, x in tokens.items():
            if tf := x.count(t):
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0.0) + idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (len(x) / (total / n))))
    return out


@pytest.mark.parametrize(
    "texts, query, want",
    [
        ({"doc-1": "cat", "doc-2": "dog"}, "cat", {"doc-1": 0.6931471805599453}),
        ({"doc-a": "cat cat", "doc-b": "cat dog"}, "cat", {"doc-a": 0.2506921405916876, "doc-b": 0.1823215567939546}),
        ({"short": "cat", "long": "cat dog bird fish"}, "cat", {"short": 0.24163097888355428, "long": 0.1463895711484307}),
        ({"a": "", "b": "  "}, "cat", {}),
        ({"a": "cat"}, "", {}),
    ],
)
def test_bm25_literals(spark, texts, query, want):
    assert scores(spark, texts, query) == pytest.approx(want, abs=1e-12)


def test_bm25_against_brute_force(spark):
    for q in QUERIES:
        assert scores(spark, CORPUS, q) == pytest.approx(brute(CORPUS, q), abs=1e-12)


def test_repeated_terms_and_params(spark):
    once, twice = scores(spark, CORPUS, "harbour"), scores(spark, CORPUS, "harbour harbour")
    assert twice == pytest.approx({i: 2 * s for i, s in once.items()}, abs=1e-12)
    flat = scores(spark, {"short": "cat", "long": "cat dog bird"}, "cat", BM25Params(b=0.0))
    assert flat["short"] == flat["long"]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "document_id string, text string")
    assert bm25.score(build_index(none), bm25.query_terms(spark, {0: "cat"})).count() == 0
    stats = index_stats(build_index(none)).first()
    assert tuple(stats) == (0, 0, 0, 0.0)


def test_ties_go_to_the_smaller_id(spark):
    texts = {i: "same text" for i in ("doc-1", "doc-2", "doc-12")}
    hits = bm25.best(bm25.score(build_index(corpus(spark, texts)), bm25.query_terms(spark, {0: "same"})), 10)
    assert [r["document_id"] for r in hits.orderBy("rank").collect()] == ["doc-1", "doc-12", "doc-2"]


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_shards_together_rank_as_one(spark, limit):
    index = build_index(corpus(spark, CORPUS))
    asked = bm25.query_terms(spark, dict(enumerate(QUERIES)))
    whole = {(r["query_id"], r["rank"]): (r["document_id"], r["score"]) for r in bm25.best(bm25.score(index, asked), limit).collect()}
    shard = F.pmod(F.xxhash64("document_id"), F.lit(3))
    p, d = index.postings.withColumn("part", shard), index.lengths.withColumn("part", shard)
    n = d.groupBy("part").agg(F.count("*").alias("n"), F.sum("dl").alias("total_len"))
    stats = merge_stats(n.join(p.groupBy("part", "term").agg(F.count("*").alias("df")), "part", "left"))
    parts = []
    for s in range(3):
        own = InvertedIndex(p.where(F.col("part") == s).drop("part"), d.where(F.col("part") == s).drop("part"))
        parts.append(bm25.best(bm25.score(own, asked, stats=stats), limit).drop("rank"))
    merged = {(r["query_id"], r["rank"]): (r["document_id"], r["score"]) for r in merged_topk(parts, limit).collect()}
    assert merged.keys() == whole.keys()
    for k, (i, s) in whole.items():
        assert merged[k][0] == i and merged[k][1] == pytest.approx(s, abs=1e-12)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    texts = {f"d{i}": " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for i in range(200)}
    one = build_index(corpus(spark, texts).repartition(1))
    many = build_index(corpus(spark, texts).repartition(13))
    asked = bm25.query_terms(spark, {0: "a b c d e f g h a"})
    got = [{r["document_id"]: r["score"] for r in bm25.score(x, asked).collect()} for x in (one, many)]
    assert got[0] == got[1]


def test_matching_and_stored_index_equal_the_whole(spark, tmp_path):
    documents = corpus(spark, CORPUS | {"empty": ""})
    whole = build_index(documents)
    asked = bm25.query_terms(spark, {0: "harbour tide chart"})
    want = sorted(map(tuple, bm25.score(whole, asked).collect()))
    assert sorted(map(tuple, bm25.score(matching(documents, ["harbour", "tide", "chart"]), asked).collect())) == want
    whole.save(f"file://{tmp_path}/index")
    stored = InvertedIndex.load(spark, f"file://{tmp_path}/index")
    looked = stored.lookup(["harbour", "tide", "chart"])
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(map(tuple, bm25.score(InvertedIndex(looked, stored.lengths), asked).collect())) == want


def test_index_figures(spark):
    index = build_index(corpus(spark, {"a": "x y x", "b": "", "c": "y"}))
    assert tuple(index_stats(index).first()) == (3, 2, 4, 4 / 3)
    assert {tuple(r) for r in corpus_stats(index, ["x", "x", "nope"]).collect()} == {("x", 1, 3, 4), ("nope", 0, 3, 4)}
    ids = spark.createDataFrame([("a",), ("z",), ("a",)], "document_id string")
    assert {tuple(r) for r in contains(index, ids).collect()} == {("a", True), ("z", False)}
    per = shard_stats(index.lengths.withColumn("shard_id", (F.col("document_id") == "a").cast("int")))
    assert tuple(cluster_stats(per).first()) == (2, 3, 4, 4 / 3)


def test_plans(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = bm25.score(matching(documents, ["failover"]), bm25.query_terms(spark, {0: "failover"}))
    top = scored.orderBy(F.desc("score"), "document_id").limit(5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in bm25.best(scored, 5)._jdf.queryExecution().executedPlan().toString()


def ranked(spark, lists):
    rows = [(q, d, 1.0 - i / 100, i + 1) for q, ids in lists.items() for i, d in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id bigint, document_id string, score double, rank int")


def test_fusion_literals(spark):
    fused = reciprocal_rank_fusion(ranked(spark, {0: ["a", "b"]}), ranked(spark, {0: ["a", "c"]}), 10, RankFusion(10))
    got = {r["document_id"]: r for r in fused.collect()}
    assert got["a"]["score"] == 0.18181818181818182 and got["b"]["score"] == 1 / 12
    assert got["b"]["semantic_rank"] is None and got["b"]["total"] == 3 and got["b"]["lexical_score"] is None
    shown = reciprocal_rank_fusion(ranked(spark, {0: ["a"]}), ranked(spark, {}), 10, explain=True).first()
    assert shown["lexical_score"] == 1.0 and shown["semantic_score"] is None and shown["score"] == 1 / 61
    two = reciprocal_rank_fusion(ranked(spark, {0: list("abc")}), ranked(spark, {0: list("def")}), 2)
    assert two.count() == 2 and {r["total"] for r in two.collect()} == {6}


def test_fusion_settings():
    assert [RankFusion().depth(n) for n in (10, 1, 50)] == [50, 5, 100]
    for bad in ({"constant": 0}, {"spread": -1}):
        with pytest.raises(ValueError):
            RankFusion(**bad)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            checked_limit(bad)


def test_vectors(spark):
    rows = [("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("xy", [0.70710678, 0.70710678, 0.0]), ("-x", [-1.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("x2", [1.0, 0.0, 0.0])]
    index = spark.createDataFrame(rows, "document_id string, vector array<float>")
    hits = [(r[0], round(r[1], 6)) for r in knn.vector_topk(index, [1, 0, 0], 10, 3).collect()]
    assert hits == [("x", 1.0), ("x2", 1.0), ("xy", 0.707107), ("y", 0.0), ("zero", 0.0), ("-x", -1.0)]
    for bad in ([1, 0], [[1, 0, 0]], [float("nan"), 0, 0]):
        with pytest.raises(ValueError):
            knn.vector_topk(index, bad, 10, 3)
    with pytest.raises(ValueError):
        knn.vector_topk(index, [1, 0, 0], 0, 3)
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, None), (9, [1.0])], "query_id bigint, vector array<float>")
    batch = [(r["query_id"], r["document_id"], r["rank"]) for r in knn.batch_topk(index, asked, 2, 3).orderBy("rank").collect()]
    assert batch == [(7, "x", 1), (7, "x2", 2)]
    assert knn.batch_topk(index, asked.where("false"), 2, 3).count() == 0


def test_batch_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(x)], "document_id string, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id bigint, vector array<float>")
    got = {(r["query_id"], r["rank"]): r["document_id"] for r in knn.batch_topk(index, asked, 5, 8).collect()}
    for q in range(20):
        order = sorted(range(300), key=lambda i: (-float(np.dot(x[q].astype(float), x[i].astype(float))), f"d{i}"))
        assert [got[q, r + 1] for r in range(5)] == [f"d{i}" for i in order[:5]]


def test_metrics(spark):
    lists = ranked(spark, {0: list("abcdef"), 1: list("abcdef"), 2: list("abcdef"), 3: list("abc"), 4: list("ab")})
    rows = [(0, ["a", "b"], "x"), (1, ["a", "f"], "x"), (2, ["f"], "y"), (3, ["c", None, "c"], None), (4, None, "y"), (5, [], "y")]
    labels = spark.createDataFrame(rows, "query_id bigint, relevant array<string>, category string")
    m = per_query(lists, labels)
    got = {r[0]: (r[1], r[2]) for r in m.collect()}
    assert got == {0: (1.0, 1.0), 1: (0.5, 1.0), 2: (0.0, 1 / 6), 3: (1.0, 1 / 3), 4: (0.0, 0.0), 5: (0.0, 0.0)}
    assert summary(m).first()["queries"] == 6
    assert {r["category"]: r["queries"] for r in by_category(m, labels).collect()} == {"x": 2, "y": 3, None: 1}
    settings = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.5, 0.2), (2, 0.5, 0.2)], "position int, mrr double, recall double")
    assert best_parameters(settings).first()["position"] == 1
    worse = m.withColumn("rr", F.col("rr") - 0.1)
    assert losses(worse, m, m).count() == 6 and losses(m, m, worse).count() == 0


def _brute_best(texts, queries, limit):
    out = {}
    for q, text in queries.items():
        found = sorted(((-round(s, 9), i, s) for i, s in brute(texts, text).items()))
        out |= {(q, r + 1): (i, len(found)) for r, (_, i, _) in enumerate(found[:limit])}
    return out


def _random_texts(count, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return {f"d{i}": " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 12))) for i in range(count)}


@pytest.mark.parametrize("shards", [1, 3])
def test_best_of_queries_and_shards_without_the_score_of_every_match(spark, monkeypatch, shards):
    """Several passes, chunks of documents and blocks give the rows of brute force; no table of all scores is written."""
    monkeypatch.setattr(best, "ROWS_A_PASS", 1024 * 4)
    texts, limit = _random_texts(700), 4
    queries = {q: f"w{q % 40} w{q * 7 % 40} w{q % 3}" for q in range(1100)} | {2000: "w1 w1", 2001: "unknown", 2002: ""}
    documents = corpus(spark, texts).repartition(5).withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(shards)).cast("string"))
    found = match(documents, [f"w{i}" for i in range(40)], along="part")
    parts = [Matches(found.rows.where(F.col("part") == str(s))) for s in range(shards)]
    asked = bm25.query_terms(spark, queries)
    got = {(r["query_id"], r["rank"]): (r["document_id"], r["total"]) for r in bm25.batch_topk(parts, asked, limit, decimals=9).collect()}
    assert got == _brute_best(texts, queries, limit)
    totals = {r[0]: r[1] for r in bm25.batch_totals(parts, asked).groupBy("query_id").agg(F.sum("total")).collect()}
    assert totals == {q: n for (q, r), (_, n) in got.items() if r == 1}


def test_tasks_keep_the_best_over_chunks():
    """Rows of several chunks, equal scores, and one query with far more rows than the others."""
    rng = np.random.default_rng(2)
    kept = best.Kept(3, 5, 3)
    every = []
    for chunk in range(6):
        ids = [f"d{chunk}-{i}" for i in range(400)]
        kept.begin(pa.array(ids))
        for q, n in ((0, 400), (1, 30), (2, 3)):
            at, score = np.arange(n), rng.integers(0, 20, n) / 10
            kept.add(0, np.full(n, q), at, score)
            every += [(q, -s, ids[i]) for i, s in zip(at, score)]
    row = next(kept.packed(0))
    table = pa.ipc.open_stream(row.column(1)[0].as_py()).read_all()
    got = sorted((q, -s, i) for q, i, s in zip(*(c.to_pylist() for c in table.columns)))
    assert got == [x for q in range(3) for x in sorted(y for y in every if y[0] == q)[:5]]


def test_batch_vectors_in_passes_with_ties(spark, monkeypatch):
    monkeypatch.setattr(best, "ROWS_A_PASS", 1024 * 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x = np.concatenate([x, x, np.zeros((20, 8), np.float32)])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    names = [f"d{i}" for i in range(len(x))]
    index = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "document_id string, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x[i % 160].tolist()) for i in range(1100)], "query_id bigint, vector array<float>")
    got = {}
    for r in knn.batch_topk(index, asked, 3, 8, 6).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["document_id"]
    scores = np.round(x.astype(float) @ x.astype(float).T, 6)
    for q in range(1100):
        want = sorted(range(len(x)), key=lambda i: (-scores[q % 160, i], names[i]))[:3]
        assert [got[q][r + 1] for r in range(3)] == [names[i] for i in want]


def test_sweep_equals_fusion_of_each_setting(spark):
    rng = random.Random(8)
    draw = lambda: {q: rng.sample([f"d{i}" for i in range(60)], rng.randint(0, 40)) for q in range(12)}
    lexical, semantic = ranked(spark, draw()), ranked(spark, draw())
    labels = spark.createDataFrame([(q, rng.sample([f"d{i}" for i in range(60)], q % 5) + [None, "d1", "d1"] * (q % 2)) for q in range(14)], "query_id bigint, relevant array<string>")
    settings = [(10, 5), (60, 20), (1, 40)]
    got = {(r["position"], r["query_id"]): (r["recall"], r["rr"]) for r in swept(lexical, semantic, labels, settings, 20, decimals=12).collect()}
    for at, (constant, depth) in enumerate(settings):
        fused = reciprocal_rank_fusion(lexical.where(F.col("rank") <= depth), semantic.where(F.col("rank") <= depth), 20, RankFusion(constant), decimals=12)
        assert {(at, r["query_id"]): (r["recall"], r["rr"]) for r in per_query(fused, labels).collect()} == {k: v for k, v in got.items() if k[0] == at}
    plan = swept(lexical, semantic, labels, settings, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
