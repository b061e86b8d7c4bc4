"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.config import RankFusion
from findery.functions.formulas import rrf_term


def reciprocal_rank_fusion(lexical: DataFrame, semantic: DataFrame, limit: int, config: RankFusion = RankFusion(), explain: bool = False, decimals: int | None = None) -> DataFrame:
    """``query_id, document_id, score, lexical_rank, semantic_rank, lexical_score, semantic_score, total, rank``.

    Each list has ``query_id, document_id, score, rank``, one row a document. An absent document adds nothing and has a
    null rank there; ``total`` is the number of candidates of the query. Scores of the lists are null unless ``explain``.
    Equal scores go to the smaller id.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    one, two = (df.select("query_id", "document_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")) for df, name in ((lexical, "lexical"), (semantic, "semantic")))
    both = one.join(two, ["query_id", "document_id"], "full_outer")
    score = rrf_term(F.col("lexical_rank"), config.constant) + rrf_term(F.col("semantic_rank"), config.constant)
    whole, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    fused = both.withColumn("score", score if decimals is None else F.round(score, decimals)).withColumn("total", F.count("*").over(whole)).withColumn("rank", F.row_number().over(order))
    shown = [F.when(F.lit(explain), F.col(c)).alias(c) for c in ("lexical_score", "semantic_score")]
    return fused.where(F.col("rank") <= limit).select("query_id", "document_id", "score", "lexical_rank", "semantic_rank", *shown, "total", "rank")
