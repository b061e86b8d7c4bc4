"""Offline evaluation of ranked lists: recall, reciprocal rank, categories, parameter sweeps, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.formulas import rrf_term
from findery.sources.scratch import materialize

TOLERANCE = 1e-9


def judged(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """``query_id, rank`` of the relevant documents that were ranked; labels have ``query_id, relevant`` (array)."""
    relevant = labels.select("query_id", F.explode(F.array_distinct("relevant")).alias("document_id")).where(F.col("document_id").isNotNull())
    return ranked.join(relevant, ["query_id", "document_id"], "left_semi").select("query_id", "rank")


def per_query(ranked: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, recall, rr`` for every labelled query.

    Recall is the share of the relevant documents among the first ``k``, 0 if none is relevant; the reciprocal rank is that
    of the first relevant document, 0 if there is none. Null and repeated relevant ids do not count.
    """
    wanted = labels.select("query_id", F.size(F.array_distinct(F.filter(F.coalesce("relevant", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("n"))
    hit = judged(ranked, labels).groupBy("query_id").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"))
    recall = F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0)
    return wanted.join(hit, "query_id", "left").select("query_id", recall.alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def swept(lexical: DataFrame, semantic: DataFrame, labels: DataFrame, settings: Sequence[tuple[int, int]], limit: int, k: int = 5, decimals: int | None = None) -> DataFrame:
    """``position, query_id, recall, rr``: ``per_query`` of the first ``limit`` of both lists' fusion, for each of
    ``settings`` (constant, depth).

    The lists are joined once. Only relevant candidates get a rank, one more than the candidates of the query that are ahead
    of it. Scores depend on the two ranks alone, so they are looked up in a table of all pairs of ranks.
    """
    spark = lexical.sparkSession
    deepest = max(depth for _, depth in settings)
    rank = lambda df, name: df.where(F.col("rank") <= deepest).select("query_id", "document_id", F.col("rank").alias(name))
    both = rank(lexical, "l").join(rank(semantic, "s"), ["query_id", "document_id"], "full_outer")
    every = spark.range((deepest + 1) ** 2).select((F.col("id") / (deepest + 1)).cast("int").alias("l"), (F.col("id") % (deepest + 1)).cast("int").alias("s"))

    def score(constant: int, depth: int) -> Column:
        own = [F.when((F.col(c) > 0) & (F.col(c) <= depth), F.col(c)) for c in ("l", "s")]
        sum_ = rrf_term(own[0], constant) + rrf_term(own[1], constant)
        return F.when(own[0].isNotNull() | own[1].isNotNull(), sum_ if decimals is None else F.round(sum_, decimals))

    names = [f"s{i}" for i in range(len(settings))]
    scores = every.select("l", "s", *(score(*x).alias(n) for n, x in zip(names, settings)))
    at = both.select("query_id", "document_id", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("s", F.lit(0)).alias("s"))
    relevant = labels.select("query_id", F.explode(F.array_distinct("relevant")).alias("document_id")).where(F.col("document_id").isNotNull())
    at = materialize(at.join(relevant.withColumn("wanted", F.lit(True)), ["query_id", "document_id"], "left"), "candidates")
    scored = at.join(F.broadcast(scores), ["l", "s"])
    judged_ = scored.where("wanted").select("query_id", F.col("document_id").alias("own"), *(F.col(n).alias(f"_{n}") for n in names))
    ahead = lambda n: (F.col(n) > F.col(f"_{n}")) | ((F.col(n) == F.col(f"_{n}")) & (F.col("document_id") < F.col("own")))
    places = scored.join(judged_, "query_id").groupBy("query_id", "own").agg(*(F.when(F.first(f"_{n}").isNotNull(), F.count(F.when(ahead(n), 1)) + 1).alias(n) for n in names))
    hits = places.groupBy("query_id").agg(*(e for n in names for e in (F.count(F.when(F.col(n) <= min(k, limit), 1)).alias(f"hits_{n}"), F.min(F.when(F.col(n) <= limit, F.col(n))).alias(f"first_{n}"))))
    wanted = labels.select("query_id", F.size(F.array_distinct(F.filter(F.coalesce("relevant", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("n"))
    each = F.posexplode(F.array(*(F.struct(F.col(f"hits_{n}").alias("hits"), F.col(f"first_{n}").alias("first")) for n in names))).alias("position", "m")
    recall = F.when(F.col("n") > 0, F.coalesce("m.hits", F.lit(0)) / F.col("n")).otherwise(0.0)
    return wanted.join(hits, "query_id", "left").select("query_id", "n", each).select("position", "query_id", recall.alias("recall"), F.coalesce(1.0 / F.col("m.first"), F.lit(0.0)).alias("rr"))


def summary(measured: DataFrame) -> DataFrame:
    """One row ``queries, recall, mrr``."""
    return measured.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def by_category(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``category, queries, mrr``; null is a category."""
    return measured.join(labels.select("query_id", "category"), "query_id").groupBy("category").agg(F.count("*").alias("queries"), F.avg("rr").alias("mrr"))


def best_parameters(results: DataFrame) -> DataFrame:
    """Of ``position, …, mrr, recall`` the row with the best mrr, then recall, then the first."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mrr"), F.desc("recall"), "position")  # a row a parameter setting
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).drop("place")


def losses(hybrid: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """``query_id, hybrid, lexical, semantic`` of queries on which fusion is worse than the better list."""
    rr = lambda df, name: df.select("query_id", F.col("rr").alias(name))
    both = rr(hybrid, "hybrid").join(rr(lexical, "lexical"), "query_id").join(rr(semantic, "semantic"), "query_id")
    return both.where(F.col("hybrid") < F.greatest("lexical", "semantic") - TOLERANCE)
