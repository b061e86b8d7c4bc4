"""Shards as data: routing, figures by shard, merging, topology and health.

Spark partitions a plan by its own hash; ``shard_id`` is kept as a column where results are to be told apart by shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.errors import InvalidTopology, ShardFailed
from findery.functions.formulas import average_length
from findery.functions.hashing import shard_col


def routed(documents: DataFrame, shards: int) -> DataFrame:
    """Documents with the shard that owns them."""
    return documents.withColumn("shard_id", shard_col("document_id", shards))


def shard_stats(lengths: DataFrame, postings: DataFrame | None = None, by: str = "shard_id") -> DataFrame:
    """``<by>, n, total_tokens, avgdl`` (and ``vocabulary``) of every shard; there is no vocabulary of the whole cluster."""
    out = lengths.groupBy(by).agg(F.count("*").alias("n"), F.sum("dl").alias("total_tokens")).withColumn("avgdl", average_length(F.col("n"), F.col("total_tokens")))
    if postings is not None:
        words = postings.groupBy(by).agg(F.count_distinct("term").alias("vocabulary"))
        out = out.join(words, by, "left").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0)))
    return out


def cluster_stats(per_shard: DataFrame) -> DataFrame:
    """One row ``shards, n, total_tokens, avgdl``: the mean over all documents, never a mean of means."""
    whole = per_shard.agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    return whole.withColumn("avgdl", average_length(F.col("n"), F.col("total_tokens")))


def merged_topk(parts: Sequence[DataFrame] | DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query out of the shards' own best, with ``rank``; a document is on one shard."""
    every = parts if isinstance(parts, DataFrame) else _union(parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def scattered_topk(scored: DataFrame, limit: int, shards: int) -> DataFrame:
    """The best ``limit`` of each query (``query_id, document_id, score``), by each shard's own best and then of all shards."""
    own = Window.partitionBy("query_id", "shard_id").orderBy(F.desc("score"), "document_id")
    parts = routed(scored, shards).withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= limit)
    return merged_topk(parts.drop("_own", "shard_id"), limit)


def merged_totals(parts: DataFrame) -> DataFrame:
    """``query_id, total`` summed over shards."""
    return parts.groupBy("query_id").agg(F.sum("total").alias("total"))


def shard_health(copies: DataFrame) -> DataFrame:
    """``shard_id, copies, ready_copies, search_available, write_available``.

    Any ready copy serves searches, only a ready primary takes writes. A copy without a state or endpoint isn't ready.
    """
    ready = F.coalesce((F.col("node_state") == "ready") & F.col("endpoint").isNotNull(), F.lit(False))
    return copies.groupBy("shard_id").agg(
        F.count("*").alias("copies"),
        F.count(F.when(ready, 1)).alias("ready_copies"),
        F.bool_or(ready).alias("search_available"),
        F.bool_or(ready & F.coalesce(F.col("copy_role") == "primary", F.lit(False))).alias("write_available"),
    )


def cluster_health(copies: DataFrame) -> DataFrame:
    """One row ``shards, ready_shards, search_available, write_available``: all shards are needed for either."""
    h = shard_health(copies)
    return h.agg(F.count("*").alias("shards"), F.count(F.when(F.col("search_available"), 1)).alias("ready_shards"), F.coalesce(F.bool_and("search_available"), F.lit(False)).alias("search_available"), F.coalesce(F.bool_and("write_available"), F.lit(False)).alias("write_available"))


def serving_copies(copies: DataFrame) -> DataFrame:
    """``shard_id, copy_no``: of every shard the copy that answers, the primary before replicas in their order."""
    ready = copies.where((F.col("node_state") == "ready") & F.col("endpoint").isNotNull())
    order = Window.partitionBy("shard_id").orderBy(F.when(F.col("copy_role") == "primary", 0).otherwise(1), "copy_no")
    return ready.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).select("shard_id", "copy_no")


def require_all_shards(copies: DataFrame) -> None:
    """Raise if any shard has no copy that may answer: there are no partial results."""
    failed = [r[0] for r in shard_health(copies).where(~F.col("search_available")).select("shard_id").orderBy("shard_id").collect()]
    if failed:
        raise ShardFailed(f"no copy of shards {failed} may answer")


def topology_faults(copies: DataFrame) -> DataFrame:
    """``fault, shard_id``: shard ids must be 0, 1, 2, …, each with one primary and as many copies as the others."""
    shards = copies.groupBy("shard_id").agg(F.count("*").alias("copies"), F.count(F.when(F.col("copy_role") == "primary", 1)).alias("primaries"))
    whole = shards.agg(F.count("*").alias("n"), F.max("copies").alias("most"))
    each = shards.crossJoin(F.broadcast(whole))
    faults = F.filter(
        F.array(
            F.when(F.col("shard_id").isNull() | (F.col("shard_id") < 0) | (F.col("shard_id") >= F.col("n")), "position"),
            F.when(F.col("primaries") != 1, "primary"),
            F.when(F.col("copies") != F.col("most"), "copies"),
        ),
        lambda x: x.isNotNull(),
    )
    return each.select(F.explode(faults).alias("fault"), "shard_id")


def require_topology(copies: DataFrame) -> None:
    fault = topology_faults(copies).first()
    if fault:
        raise InvalidTopology(f"shard {fault['shard_id']}: {fault['fault']}")
