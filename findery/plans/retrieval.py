"""Queries on vectors, fusion and evaluation, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import RankFusion
from findery.functions.analysis import tokens_col
from findery.functions.embedding import Identity, TokenTableEmbedder, TopicEmbedder, fingerprint_col, synthetic_text
from findery.functions.vectors import norm, storable, well_formed
from findery.operators import bm25, knn
from findery.operators.evaluation import best_parameters, by_category, losses, per_query, summary, swept
from findery.operators.fusion import reciprocal_rank_fusion
from findery.operators.index import Matches, counted_index, match, merge_stats
from findery.operators.invariants import vector_violations
from findery.operators.sharding import routed, scattered_topk
from findery.plans import duck
from findery.plans.lexical import labelled_terms, labelled_topk
from findery.sources.scratch import materialize
from findery.sources.tables import table

WIDTH, LIMIT, DECIMALS, SHARDS = 64, 10, 6, 8
TOPICS = (("replica", "shard", "failover"), ("query", "search", "index"), ("cache", "latency", "memory"), ("version", "release", "patch"))
SWEEP = [(k, d) for k in (10, 30, 60) for d in (20, 40, 100)]
VOCABULARY = ["search", "index", "query", "shard", "replica", "token", "cache", "merge", "vector", "score", "rank"]


def _vectors(spark, folder) -> DataFrame:
    return knn.normalized_index(table(spark, folder, "doc_vectors").where(F.col("document_id").isNotNull()), WIDTH)


def _query_vectors(spark, folder) -> DataFrame:
    return knn.normalized_index(table(spark, folder, "labelled_queries"), WIDTH, "query_id", "query_vector").withColumnRenamed("document_id", "query_id")


def _semantic(spark, folder, depth: int) -> DataFrame:
    return knn.batch_topk(_vectors(spark, folder), _query_vectors(spark, folder), depth, WIDTH, DECIMALS)


def vector_norms(spark, folder):
    """Norm and validity of every stored vector; the norm is null where it is not a number."""
    v = F.col("vector")
    good = well_formed(v, WIDTH)
    return table(spark, folder, "doc_vectors").select("vec_id", F.when(good, F.round(norm(v), 6)).alias("norm"), good.alias("well_formed"), F.coalesce(storable(v, WIDTH), F.lit(False)).alias("storable"))


def vector_topk(spark, folder):
    """The ten vectors nearest to that of the first labelled query that has one."""
    q = _query_vectors(spark, folder).orderBy("query_id").first()
    hits = knn.vector_topk(_vectors(spark, folder), q["vector"], LIMIT, WIDTH, DECIMALS)
    return bm25.best(hits.withColumn("query_id", F.lit(0)), LIMIT).select("document_id", "score", "rank")


def vector_batch_topk(spark, folder):
    """The ten nearest documents of every labelled query."""
    return _semantic(spark, folder, LIMIT)


def embeddings_batch_topk(spark, folder):
    """The ten nearest rows of embeddings of every row whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    index = knn.normalized_index(e.withColumn("document_id", F.col("vec_id").cast("string")), WIDTH, "document_id", "embedding")
    asked = knn.normalized_index(e.where(F.col("vec_id") % 100 == 0), WIDTH, "vec_id", "embedding").withColumnRenamed("document_id", "query_id")
    return knn.batch_topk(index, asked, LIMIT, WIDTH, DECIMALS)


def semantic_totals(spark, folder):
    """Vectors searched for every labelled query with a vector: all of them."""
    n = _vectors(spark, folder).agg(F.count("*").alias("total"))
    return _query_vectors(spark, folder).select("query_id").crossJoin(F.broadcast(n))


def vector_invariant_violations(spark, folder):
    """What is wrong with stored vectors."""
    return vector_violations(table(spark, folder, "doc_vectors").select(F.col("vec_id").alias("document_id"), "vector"), WIDTH)


def topic_embedding(spark, folder):
    """Topic counts of every document as a unit vector, one column a dimension."""
    v = TopicEmbedder(TOPICS).embed(table(spark, folder, "documents"))
    return v.select("document_id", *(F.round(F.col("vector")[i].cast("double"), 5).alias(f"v{i}") for i in range(len(TOPICS) + 1)))


def token_table_embedding(spark, folder):
    """Mean token vector of every document; a token's vector here is its length and 1."""
    words = table(spark, folder, "documents").select(F.explode(tokens_col("text")).alias("token")).distinct()
    vectors = words.select("token", F.array(F.length("token").cast("double"), F.lit(1.0)).alias("vector"))
    v = TokenTableEmbedder(vectors, Identity("table", "length", "1", 2)).embed(table(spark, folder, "documents"))
    return v.select("document_id", *(F.round(F.col("vector")[i].cast("double"), 5).alias(f"v{i}") for i in range(2)))


def fingerprints(spark, folder):
    """Fingerprint of an embedder of each stored width, and whether it is that of the vector's row."""
    made = fingerprint_col(F.lit("static"), F.lit("lumen-64"), F.lit("r3"), F.size("vector"), F.lit("l2"))
    return table(spark, folder, "doc_vectors").where(F.col("vector").isNotNull()).select("vec_id", made.alias("expected"), (made == F.col("fingerprint")).alias("same"))


def synthetic_texts(spark, folder):
    """A benchmark text for every document, by its number."""
    return table(spark, folder, "documents").select("doc_id", synthetic_text(F.col("doc_id"), VOCABULARY).alias("text"))


def _lists(spark, folder, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries, lexical = labelled_topk(spark, folder, depth)
    return queries, lexical, _semantic(spark, folder, depth)


def _fused(spark, folder, explain: bool = False) -> DataFrame:
    config = RankFusion()
    _, lexical, semantic = _lists(spark, folder, config.depth(LIMIT))
    return reciprocal_rank_fusion(lexical, semantic, LIMIT, config, explain, 12)


def shard_search_lexical(spark, folder):
    """The ten best documents of every labelled query out of each shard's own best, scored with the figures of all shards."""
    return _scattered_lexical(spark, folder, LIMIT).select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


def _scattered_lexical(spark, folder, depth: int) -> DataFrame:
    documents = routed(table(spark, folder, "documents").select("document_id", "text"), SHARDS).withColumn("part", F.coalesce(F.col("shard_id").cast("string"), F.lit("0")))
    asked, words = labelled_terms(spark, folder)
    found = None if words is None else match(documents, words, along="part")
    index = counted_index(documents, along="part") if found is None else found.index()
    # first round: what each shard knows of the terms; second round: scores with the sums
    n = index.lengths.groupBy("part").agg(F.count("*").alias("n"), F.sum("dl").alias("total_len"))
    df = index.postings.join(F.broadcast(asked.select("term").distinct()) if found else asked.select("term").distinct(), "term", "left_semi").groupBy("part", "term").agg(F.count("*").alias("df"))
    shared = merge_stats(n.join(df, "part", "left"))
    if found is None:
        scored = bm25.score(index, asked, stats=shared)
        return scattered_topk(scored.withColumn("score", F.round("score", 9)), depth, SHARDS)
    shards = [Matches(found.rows.where(F.col("part") == str(s))) for s in range(SHARDS)]
    return bm25.batch_topk(shards, asked, depth, decimals=9, stats=shared)


def shard_search_semantic(spark, folder):
    """The ten nearest documents of every labelled query out of each shard's own nearest."""
    return _scattered_semantic(spark, folder, LIMIT).select("query_id", "document_id", "score", "rank")


def _scattered_semantic(spark, folder, depth: int) -> DataFrame:
    vectors, asked = materialize(routed(_vectors(spark, folder), SHARDS), "shard-vectors", ["shard_id"]), _query_vectors(spark, folder)
    return knn.batch_topk([vectors.where(F.col("shard_id") == s) for s in range(SHARDS)], asked, depth, WIDTH, DECIMALS)


def shard_search_hybrid(spark, folder):
    """The ten best of both searches over shards for every labelled query."""
    config = RankFusion()
    depth = config.depth(LIMIT)
    fused = reciprocal_rank_fusion(_scattered_lexical(spark, folder, depth), _scattered_semantic(spark, folder, depth), LIMIT, config, decimals=12)
    return fused.select("query_id", "document_id", F.round("score", 9).alias("score"), "rank", "total")


def rrf_hybrid_topk(spark, folder):
    """The ten best of both searches for every labelled query."""
    return _fused(spark, folder).select("query_id", "document_id", F.round("score", 9).alias("score"), "rank", "total")


def rrf_hybrid_explain(spark, folder):
    """The same with ranks and scores of both lists."""
    f = _fused(spark, folder, True)
    return f.select("query_id", "document_id", "rank", "lexical_rank", "semantic_rank", F.round("lexical_score", 6).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"))


def hybrid_candidate_union_total(spark, folder):
    """Candidates of every labelled query that has any."""
    return _fused(spark, folder).select("query_id", "total").distinct()


def _measured(spark, folder) -> tuple[DataFrame, dict[str, DataFrame]]:
    queries, lexical, semantic = _lists(spark, folder, 100)
    lexical, semantic = materialize(lexical, "lexical"), materialize(semantic, "semantic")
    hybrid = reciprocal_rank_fusion(lexical, semantic, 20, RankFusion(), decimals=12)
    cut = lambda df: df.where(F.col("rank") <= 20)
    return queries, {name: per_query(df, queries) for name, df in (("hybrid", hybrid), ("lexical", cut(lexical)), ("semantic", cut(semantic)))}


def recall_at_k(spark, folder):
    """Recall at 5 and reciprocal rank of every labelled query, for each search."""
    per = _measured(spark, folder)[1]
    return reduce(DataFrame.unionByName, (m.select(F.lit(n).alias("search"), "query_id", F.round("recall", 9).alias("recall"), F.round("rr", 9).alias("rr")) for n, m in per.items()))


def mrr_summary(spark, folder):
    """Mean recall and reciprocal rank of each search."""
    per = _measured(spark, folder)[1]
    return reduce(DataFrame.unionByName, (summary(m).select(F.lit(n).alias("search"), "queries", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr")) for n, m in per.items()))


def mrr_by_category(spark, folder):
    """Mean reciprocal rank by category and search."""
    queries, per = _measured(spark, folder)
    return reduce(DataFrame.unionByName, (by_category(m, queries).select(F.lit(n).alias("search"), "category", "queries", F.round("mrr", 9).alias("mrr")) for n, m in per.items()))


def hybrid_losses(spark, folder):
    """Queries on which fusion is worse than the better of its lists."""
    per = _measured(spark, folder)[1]
    lost = losses(per["hybrid"], per["lexical"], per["semantic"])
    return lost.select("query_id", *(F.round(c, 9).alias(c) for c in ("hybrid", "lexical", "semantic")))


def _swept(spark, folder) -> DataFrame:
    queries, lexical, semantic = _lists(spark, folder, 100)
    lexical, semantic = materialize(lexical, "lexical"), materialize(semantic, "semantic")
    each = swept(lexical, semantic, queries, SWEEP, 20, decimals=12).groupBy("position").agg(F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"))
    setting = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in SWEEP)), F.col("position") + 1)
    positions = spark.range(len(SWEEP)).select(F.col("id").cast("int").alias("position"))  # each has a row without queries too
    return positions.join(each, "position", "left").select("position", setting(0).alias("rrf_k"), setting(1).alias("depth"), F.round("mrr", 9).alias("mrr"), F.round("recall", 9).alias("recall"))


def rrf_parameter_sweep(spark, folder):
    """Mean figures of every parameter setting."""
    return _swept(spark, folder)


def rrf_best_parameters(spark, folder):
    """The setting with the best mean reciprocal rank, then recall, then the first."""
    return best_parameters(_swept(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        vector_norms, vector_topk, vector_batch_topk, embeddings_batch_topk, semantic_totals, vector_invariant_violations, topic_embedding, token_table_embedding, fingerprints, synthetic_texts,
        shard_search_lexical, shard_search_semantic, shard_search_hybrid, rrf_hybrid_topk, rrf_hybrid_explain, hybrid_candidate_union_total, recall_at_k, mrr_summary, mrr_by_category, hybrid_losses, rrf_parameter_sweep, rrf_best_parameters,
    )
}


def sql() -> dict[str, str]:
    vectors = f"{duck.unit('dv', '(SELECT * FROM doc_vectors WHERE document_id IS NOT NULL)', 'document_id', 'vector')}, {duck.unit('qv', 'labelled_queries', 'query_id', 'query_vector')}"
    near = f"{vectors}, m AS (SELECT qv.id AS query_id, dv.id AS document_id, round({duck.dot('qv.v', 'dv.v')}, 6) AS score FROM qv CROSS JOIN dv), {duck.ranked('n', 'm', 'score')}"
    lists = f"WITH {duck.index()}, {duck.scored(duck.labelled())}, {duck.ranked('l', 'h')}, {near}"

    def fused(name: str = "f", depth: int = 50, k: int = 60) -> str:
        both = f"SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.document_id, n.document_id) AS document_id, l.rank AS lexical_rank, n.rank AS semantic_rank, l.score AS lexical_score, n.score AS semantic_score, round(coalesce(1.0::DOUBLE / ({k} + l.rank), 0) + coalesce(1.0::DOUBLE / ({k} + n.rank), 0), 12) AS score FROM (SELECT * FROM l WHERE rank <= {depth}) l FULL JOIN (SELECT * FROM n WHERE rank <= {depth}) n ON l.query_id = n.query_id AND l.document_id = n.document_id"
        return f"{name}0 AS ({both}), {name} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM {name}0)"

    wanted = "w AS (SELECT query_id, unnest(list_distinct(list_filter(coalesce(relevant, []), lambda x: x IS NOT NULL))) AS document_id FROM labelled_queries), wn AS (SELECT query_id, category, len(list_distinct(list_filter(coalesce(relevant, []), lambda x: x IS NOT NULL))) AS n FROM labelled_queries)"

    def measured(name: str, ranked: str) -> str:
        return f"{name} AS (SELECT wn.query_id, any_value(wn.category) AS category, CASE WHEN any_value(wn.n) > 0 THEN count(CASE WHEN r.rank <= 5 THEN 1 END) / any_value(wn.n) ELSE 0.0 END AS recall, coalesce(1.0::DOUBLE / min(r.rank), 0.0) AS rr FROM wn LEFT JOIN (SELECT r.query_id, r.rank FROM {ranked} r JOIN w ON r.query_id = w.query_id AND r.document_id = w.document_id WHERE r.rank <= 20) r ON wn.query_id = r.query_id GROUP BY wn.query_id)"

    three = f"{lists}, {fused(depth=100)}, {wanted}, {measured('mh', 'f')}, {measured('ml', 'l')}, {measured('ms', 'n')}"
    each = lambda what, tail="": " UNION ALL ".join(f"SELECT '{s}' AS search, {what} FROM {t}{tail}" for s, t in (("hybrid", "mh"), ("lexical", "ml"), ("semantic", "ms")))
    sweep = f"{lists}, {wanted}, " + ", ".join(f"{fused(f'f{i}', d, k)}, {measured(f'm{i}', f'f{i}')}" for i, (k, d) in enumerate(SWEEP))
    swept = " UNION ALL ".join(f"SELECT {i} AS position, {k} AS rrf_k, {d} AS depth, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall FROM m{i}" for i, (k, d) in enumerate(SWEEP))
    v = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isfinite(x))) = 64"
    length = "sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE)))"
    counts = [f"len(list_filter(tokens, lambda x: x IN ({', '.join(repr(w) for w in t)})))::DOUBLE" for t in TOPICS] + ["0.25::DOUBLE"]
    square = " + ".join(f"c{i} * c{i}" for i in range(5))
    e = duck.unit("ev", "embeddings", "vec_id", "embedding")
    return {
        "vector_norms": f"SELECT vec_id, CASE WHEN {v} THEN round({length}, 6) END AS norm, coalesce({v}, false) AS well_formed, coalesce({v} AND ({length} = 0 OR abs({length} - 1) <= 1e-3), false) AS storable FROM doc_vectors",
        "vector_topk": f"WITH {near} SELECT document_id, score, rank FROM n WHERE query_id = (SELECT min(id) FROM qv) AND rank <= 10",
        "vector_batch_topk": f"WITH {near} SELECT query_id, document_id, score, rank FROM n WHERE rank <= 10",
        "embeddings_batch_topk": f"WITH {e}, m AS (SELECT a.id AS query_id, b.id::VARCHAR AS document_id, round({duck.dot('a.v', 'b.v')}, 6) AS score FROM ev a CROSS JOIN ev b WHERE a.id % 100 = 0), {duck.ranked('n', 'm', 'score')} SELECT query_id, document_id, score, rank FROM n WHERE rank <= 10",
        "semantic_totals": f"WITH {vectors} SELECT id AS query_id, (SELECT count(*) FROM dv) AS total FROM qv",
        "vector_invariant_violations": f"SELECT * FROM (SELECT CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 64 THEN 'width' WHEN len(list_filter(vector, lambda x: isfinite(x))) <> 64 THEN 'not finite' WHEN {length} <> 0 AND abs({length} - 1) > 1e-3 THEN 'norm' END AS rule, vec_id::VARCHAR AS subject FROM doc_vectors) WHERE rule IS NOT NULL UNION ALL SELECT 'vector twice', vec_id::VARCHAR FROM doc_vectors GROUP BY vec_id HAVING count(*) > 1",
        "topic_embedding": f"WITH {duck.analyzed()}, c AS (SELECT document_id, {', '.join(f'{x} AS c{i}' for i, x in enumerate(counts))} FROM t) SELECT document_id, {', '.join(f'round((c{i} / sqrt({square}))::FLOAT::DOUBLE, 5) AS v{i}' for i in range(5))} FROM c",
        "token_table_embedding": f"WITH {duck.analyzed()}, c AS (SELECT document_id, CASE WHEN dl > 0 THEN list_sum(list_transform(tokens, lambda x: length(x)))::DOUBLE / dl ELSE 0 END AS a, CASE WHEN dl > 0 THEN 1.0 ELSE 0 END AS b FROM t) SELECT document_id, round(CASE WHEN b = 0 THEN 0.0 ELSE (a / sqrt(a * a + b * b))::FLOAT::DOUBLE END, 5) AS v0, round(CASE WHEN b = 0 THEN 0.0 ELSE (b / sqrt(a * a + b * b))::FLOAT::DOUBLE END, 5) AS v1 FROM c",
        "fingerprints": "SELECT vec_id, 'static:lumen-64@r3/d' || len(vector) || '/l2' AS expected, ('static:lumen-64@r3/d' || len(vector) || '/l2') = fingerprint AS same FROM doc_vectors WHERE vector IS NOT NULL",
        "synthetic_texts": f"SELECT doc_id, array_to_string(list_transform(range(40), lambda i: {VOCABULARY!r}[((doc_id * 7 + i) % {len(VOCABULARY)})::INT + 1]), ' ') AS text FROM documents",
        "shard_search_lexical": f"{lists} SELECT query_id, document_id, round(score, 6) AS score, rank FROM l WHERE rank <= 10",
        "shard_search_semantic": f"WITH {near} SELECT query_id, document_id, score, rank FROM n WHERE rank <= 10",
        "shard_search_hybrid": f"{lists}, {fused()} SELECT query_id, document_id, round(score, 9) AS score, rank, total FROM f WHERE rank <= 10",
        "rrf_hybrid_topk": f"{lists}, {fused()} SELECT query_id, document_id, round(score, 9) AS score, rank, total FROM f WHERE rank <= 10",
        "rrf_hybrid_explain": f"{lists}, {fused()} SELECT query_id, document_id, rank, lexical_rank, semantic_rank, round(lexical_score, 6) AS lexical_score, round(semantic_score, 6) AS semantic_score FROM f WHERE rank <= 10",
        "hybrid_candidate_union_total": f"{lists}, {fused()} SELECT DISTINCT query_id, total FROM f",
        "recall_at_k": f"{three} {each('query_id, round(recall, 9) AS recall, round(rr, 9) AS rr')}",
        "mrr_summary": f"{three} {each('count(*) AS queries, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr')}",
        "mrr_by_category": f"{three} {each('category, count(*) AS queries, round(avg(rr), 9) AS mrr', ' GROUP BY category')}",
        "hybrid_losses": f"{three} SELECT mh.query_id, round(mh.rr, 9) AS hybrid, round(ml.rr, 9) AS lexical, round(ms.rr, 9) AS semantic FROM mh JOIN ml USING (query_id) JOIN ms USING (query_id) WHERE mh.rr < greatest(ml.rr, ms.rr) - 1e-9",
        "rrf_parameter_sweep": f"{sweep} {swept}",
        "rrf_best_parameters": f"{sweep} SELECT * FROM ({swept}) ORDER BY mrr DESC, recall DESC, position LIMIT 1",
    }
