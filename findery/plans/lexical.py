"""Queries on analysis, the index and lexical search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.config import BM25Params
from findery.functions.analysis import tokens_col
from findery.functions.formulas import idf
from findery.operators import bm25
from findery.operators.index import analyzed, build_index, contains, corpus_stats, counted_index, document_frequency, index_stats, match, matching, merge_stats, totals
from findery.operators.sharding import cluster_stats, merged_topk, merged_totals, shard_stats
from findery.plans import duck
from findery.sources.scratch import materialize
from findery.sources.tables import table

WORDS = ("failover", "time", "of", "the", "query", "parser")
REPEATED = ("search", "index", "search")
LIMIT, DECIMALS = 10, 9


def search(spark: SparkSession, folder: str, words: tuple[str, ...], params: BM25Params = BM25Params()) -> DataFrame:
    """``query_id, document_id, score`` of one query's matches."""
    return bm25.score(matching(table(spark, folder, "documents"), words), bm25.query_terms(spark, {0: words}), params)


def labelled_topk(spark: SparkSession, folder: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The labelled queries, and the first of each (``query_id, document_id, score, rank, total``)."""
    queries = table(spark, folder, "labelled_queries")
    documents = table(spark, folder, "documents")
    asked, words = labelled_terms(spark, folder)
    if words is not None:
        return queries, bm25.batch_topk(match(documents, words), asked, limit, decimals=DECIMALS)
    scored = materialize(bm25.score(counted_index(documents), asked), "labelled-scores")
    return queries, bm25.best(scored, limit, DECIMALS).join(bm25.match_totals(scored, queries), "query_id")


def labelled_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str] | None]:
    """The terms of the labelled queries (``query_id, pos, term``), and the distinct ones unless there are too many for every task."""
    asked = materialize(bm25.query_table_terms(table(spark, folder, "labelled_queries")), "labelled-terms")
    if asked.count() > bm25.BROADCAST_TERMS:
        return asked, None
    return asked, [r[0] for r in asked.select("term").distinct().collect()]


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def analyze_token_counts(spark, folder):
    """Number of terms, of distinct terms and of characters in terms, of every document."""
    t = analyzed(table(spark, folder, "documents"))
    letters = F.aggregate("tokens", F.lit(0), lambda s, x: s + F.length(x))
    return t.select("document_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"), letters.alias("n_letters"))


def postings(spark, folder):
    """Every posting."""
    return build_index(table(spark, folder, "documents")).postings


def term_frequency_top(spark, folder):
    """The 100 most frequent terms."""
    total = build_index(table(spark, folder, "documents")).postings.groupBy("term").agg(F.sum("tf").alias("occurrences"))
    return total.orderBy(F.desc("occurrences"), "term").limit(100)


def document_frequencies(spark, folder):
    """Document frequency of every term."""
    return document_frequency(build_index(table(spark, folder, "documents")).postings)


def document_lengths(spark, folder):
    """Terms of every document, 0 for one without."""
    return build_index(table(spark, folder, "documents")).lengths


def index_statistics(spark, folder):
    """N, vocabulary, tokens and mean length."""
    return index_stats(counted_index(table(spark, folder, "documents"))).withColumn("avgdl", F.round("avgdl", 6))


def corpus_stats_for_terms(spark, folder):
    """Figures for a query's terms, unknown ones included."""
    return corpus_stats(matching(table(spark, folder, "documents"), [*WORDS, "zzzunknown"]), [*WORDS, "zzzunknown"])


def idf_values(spark, folder):
    """idf of every term."""
    index = counted_index(table(spark, folder, "documents"))
    return document_frequency(index.postings).crossJoin(F.broadcast(totals(index.lengths))).select("term", F.round(idf(F.col("n"), F.col("df")), 9).alias("idf"))


def posting_list_lookup(spark, folder):
    """Postings of three terms."""
    return matching(table(spark, folder, "documents"), ["failover", "tokenizer", "zzzunknown"]).postings


def containment(spark, folder):
    """Whether each relevant id of the labelled queries is indexed."""
    ids = table(spark, folder, "labelled_queries").select(F.explode("relevant").alias("document_id")).where(F.col("document_id").isNotNull())
    return contains(build_index(table(spark, folder, "documents")), ids)


def bm25_topk(spark, folder):
    """The ten best documents of one query."""
    return _shown(bm25.best(search(spark, folder, WORDS), LIMIT, DECIMALS)).select("document_id", "score", "rank")


def bm25_repeated_terms(spark, folder):
    """A query that repeats a term."""
    return _shown(bm25.best(search(spark, folder, REPEATED), LIMIT, DECIMALS)).select("document_id", "score", "rank")


def bm25_custom_params(spark, folder):
    """Other k1 and b."""
    return _shown(bm25.best(search(spark, folder, WORDS, BM25Params(2.0, 0.3)), LIMIT, DECIMALS)).select("document_id", "score", "rank")


def bm25_with_text(spark, folder):
    """Hits with their text, joined after ranking."""
    hits = bm25.best(search(spark, folder, WORDS), LIMIT, DECIMALS)
    return bm25.with_text(_shown(hits), table(spark, folder, "documents")).select("document_id", "score", "rank", "text")


def bm25_scores(spark, folder):
    """The score of every match of one query."""
    return _shown(search(spark, folder, WORDS)).select("document_id", "score")


def bm25_totals(spark, folder):
    """Matching documents of every labelled query, 0 where it has no terms or none is known."""
    queries, hits = labelled_topk(spark, folder, 1)
    return queries.select("query_id").join(hits.select("query_id", "total"), "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def bm25_batch_topk(spark, folder):
    """The ten best documents of every labelled query."""
    return _shown(labelled_topk(spark, folder, LIMIT)[1]).select("query_id", "document_id", "score", "rank")


def _by_source(spark, folder):
    return table(spark, folder, "documents").select("document_id", "text", F.coalesce("source", F.lit("")).alias("shard"))


def shard_statistics(spark, folder):
    """Figures of every source, taken as a shard."""
    index = counted_index(_by_source(spark, folder), along="shard")
    per = shard_stats(index.lengths, index.postings, "shard")
    return per.withColumn("avgdl", F.round("avgdl", 6))


def cluster_statistics(spark, folder):
    """Figures of all sources together, from those of each."""
    index = counted_index(_by_source(spark, folder), along="shard")
    return cluster_stats(shard_stats(index.lengths, by="shard")).withColumn("avgdl", F.round("avgdl", 6))


def shard_merge_stats(spark, folder):
    """Figures for a query's terms summed over the shards' answers."""
    documents = _by_source(spark, folder)
    index = matching(documents, WORDS)
    of = documents.select("document_id", F.col("shard").alias("part"))
    n = index.lengths.join(of, "document_id").groupBy("part").agg(F.count("*").alias("n"), F.sum("dl").alias("total_len"))
    df = index.postings.join(of, "document_id").groupBy("part", "term").agg(F.count("*").alias("df"))
    return merge_stats(n.join(df, "part", "left"))


def shard_merge_topk(spark, folder):
    """The ten best of one query, out of every source's own ten best."""
    scored = search(spark, folder, WORDS).withColumn("score", F.round("score", DECIMALS))
    documents = _by_source(spark, folder).select("document_id", "shard")
    own = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "document_id")
    parts = scored.join(documents, "document_id").withColumn("own", F.row_number().over(own)).where(F.col("own") <= LIMIT)
    return _shown(merged_topk(parts.drop("own", "shard"), LIMIT)).select("document_id", "score", "rank")


def shard_merge_totals(spark, folder):
    """Matches of every labelled query that has one, summed over sources.

    A document is of one source, so totals of sources are sums of counts of documents, and any parts of them may be added.
    """
    asked, words = labelled_terms(spark, folder)
    documents = _by_source(spark, folder)
    if words is not None:
        return merged_totals(bm25.batch_totals(match(documents, words), asked))
    scored = bm25.score(counted_index(documents), asked)
    per = scored.join(documents.select("document_id", "shard"), "document_id").groupBy("shard", "query_id").agg(F.count("*").alias("total"))
    return merged_totals(per)


def query_term_list(spark, folder):
    """Distinct sorted terms of every labelled query, joined by blanks."""
    q = table(spark, folder, "labelled_queries").select("query_id", tokens_col("query").alias("w"))
    return q.select("query_id", F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("terms"))


QUERIES = {
    f.__name__: f
    for f in (
        analyze_token_counts, postings, term_frequency_top, document_frequencies, document_lengths, index_statistics, corpus_stats_for_terms, idf_values, posting_list_lookup, containment,
        bm25_topk, bm25_repeated_terms, bm25_custom_params, bm25_with_text, bm25_scores, bm25_totals, bm25_batch_topk,
        shard_statistics, cluster_statistics, shard_merge_stats, shard_merge_topk, shard_merge_totals, query_term_list,
    )
}


def sql() -> dict[str, str]:
    index, terms = duck.index(), duck.words(*WORDS)
    top = lambda asked, k1=1.2, b=0.75: f"WITH {index}, {duck.scored(asked, k1, b)}, {duck.ranked('r', 'h')}"
    show = "SELECT document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"
    inlist = ", ".join(f"'{w}'" for w in WORDS)
    labelled = f"WITH {index}, {duck.scored(duck.labelled())}"
    source = "src AS (SELECT document_id, coalesce(source, '') AS shard FROM documents)"
    return {
        "analyze_token_counts": f"WITH {duck.analyzed()} SELECT document_id, dl AS n_tokens, len(list_distinct(tokens)) AS n_distinct, length(array_to_string(tokens, '')) AS n_letters FROM t",
        "postings": f"WITH {index} SELECT term, document_id, tf, dl FROM p",
        "term_frequency_top": f"WITH {index} SELECT term, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term ORDER BY occurrences DESC, term LIMIT 100",
        "document_frequencies": f"WITH {index} SELECT term, df FROM d",
        "document_lengths": f"WITH {duck.analyzed()} SELECT document_id, dl FROM t",
        "index_statistics": f"WITH {index} SELECT n, (SELECT count(*) FROM d) AS vocabulary, total_len AS total_tokens, round(avgdl, 6) AS avgdl FROM s",
        "corpus_stats_for_terms": f"WITH {index}, a AS (SELECT DISTINCT term FROM ({terms} UNION ALL SELECT 0, 9, 'zzzunknown')) SELECT a.term, coalesce(d.df, 0) AS df, s.n, s.total_len FROM a LEFT JOIN d ON a.term = d.term CROSS JOIN s",
        "idf_values": f"WITH {index} SELECT term, round({duck.idf('n', 'df')}, 9) AS idf FROM d CROSS JOIN s",
        "posting_list_lookup": f"WITH {index} SELECT term, document_id, tf, dl FROM p WHERE term IN ('failover', 'tokenizer', 'zzzunknown')",
        "containment": "WITH a AS (SELECT DISTINCT unnest(relevant) AS document_id FROM labelled_queries) SELECT a.document_id, d.document_id IS NOT NULL AS indexed FROM a LEFT JOIN documents d ON a.document_id = d.document_id WHERE a.document_id IS NOT NULL",
        "bm25_topk": f"{top(terms)} {show}",
        "bm25_repeated_terms": f"{top(duck.words(*REPEATED))} {show}",
        "bm25_custom_params": f"{top(terms, 2.0, 0.3)} {show}",
        "bm25_with_text": f"{top(terms)} SELECT document_id, round(score, 6) AS score, rank, text FROM r JOIN documents USING (document_id) WHERE rank <= 10",
        "bm25_scores": f"WITH {index}, {duck.scored(terms)} SELECT document_id, round(score, 6) AS score FROM h",
        "bm25_totals": f"{labelled} SELECT l.query_id, count(h.document_id) AS total FROM labelled_queries l LEFT JOIN h ON l.query_id = h.query_id GROUP BY l.query_id",
        "bm25_batch_topk": f"{labelled}, {duck.ranked('r', 'h')} SELECT query_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
        "shard_statistics": f"WITH {index}, {source}, v AS (SELECT shard, count(DISTINCT term) AS vocabulary FROM p JOIN src USING (document_id) GROUP BY shard) SELECT shard, count(*) AS n, sum(dl)::BIGINT AS total_tokens, round(sum(dl) / count(*), 6) AS avgdl, coalesce(any_value(vocabulary), 0) AS vocabulary FROM t JOIN src USING (document_id) LEFT JOIN v USING (shard) GROUP BY shard",
        "cluster_statistics": f"WITH {duck.analyzed()} SELECT (SELECT count(DISTINCT coalesce(source, '')) FROM documents) AS shards, count(*) AS n, sum(dl)::BIGINT AS total_tokens, round(sum(dl) / count(*), 6) AS avgdl FROM t",
        "shard_merge_stats": f"WITH {index} SELECT d.term, d.df, s.n, s.total_len FROM d CROSS JOIN s WHERE d.term IN ({inlist})",
        "shard_merge_topk": f"{top(terms)} {show}",
        "shard_merge_totals": f"{labelled} SELECT query_id, count(*) AS total FROM h GROUP BY query_id",
        "query_term_list": f"SELECT query_id, array_to_string(list_sort(list_distinct(coalesce({duck.tokens('query')}, []))), ' ') AS terms FROM labelled_queries",
    }
