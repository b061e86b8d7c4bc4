"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.llm.distinctiveness import query_terms, record_terms
from findery.llm.encoding import wrongly_decoded
from findery.llm.frequencies import map_frequencies, map_record_count, mark, ngram_frequencies
from findery.llm.leakage import leaks
from findery.llm.near_duplicates import near_duplicates
from findery.llm.neighbours import most_similar
from findery.llm.outranking import net_flow
from findery.llm.splitting import cut_texts, pieces
from findery.llm.tokenizing import decode, encode
from findery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in too few or too many documents."""
    documents, answers = table(spark, folder, "documents"), table(spark, folder, "corpus_stats")
    of_text = ngram_frequencies(documents).crossJoin(F.broadcast(documents.agg(F.count("text").alias("total")))).select(F.lit("text").alias("field"), "term", "records", "total")
    of_maps = map_frequencies(answers).crossJoin(F.broadcast(map_record_count(answers))).select(F.lit("document_frequencies").alias("field"), "term", "records", "total")
    both = of_text.unionByName(of_maps).withColumn("mark", mark(F.col("records"), F.col("total")))
    return both.where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and record counts of every run of one to three terms that occurs more than once."""
    return ngram_frequencies(table(spark, folder, "documents"), max_n=3).where(F.col("occurrences") > 1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The most distinctive terms of every document and every query."""
    of_text = record_terms(table(spark, folder, "documents"))
    of_maps = query_terms(table(spark, folder, "corpus_stats"), table(spark, folder, "labelled_queries"))
    return of_text.select(F.lit("text").alias("field"), F.col("doc_id").alias("record_id"), "term").unionByName(of_maps.select(F.lit("document_frequencies").alias("field"), F.col("query_id").alias("record_id"), "term"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents whose runs of three terms overlap by 0.7 or more."""
    return near_duplicates(table(spark, folder, "documents"), shingle=3, similarity=0.7, min_terms=20).record_pairs("doc_id")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, group and number of links of every document, by runs of five terms and 0.8 or more."""
    return near_duplicates(table(spark, folder, "documents")).groups("doc_id", every=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 nearest of the other."""
    near = most_similar(table(spark, folder, "doc_vectors"))
    return near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p4_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other vectors of every valid vector with their scores."""
    return most_similar(table(spark, folder, "doc_vectors"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The coarsest unit at which every document that is too long can be cut."""
    return cut_texts(table(spark, folder, "documents")).select("doc_id", "boundary")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document that is too long."""
    return pieces(table(spark, folder, "documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first 10 documents of every query by net flow over reciprocal positions in the two lists. No two of these differ
    by the preference threshold of 1, so net flow ranks as their sum, which is worked out from it to compare 12 decimals."""
    flow = net_flow(table(spark, folder, "hybrid_hits"), {"lexical_score": 1.0, "semantic_score": 1.0}, scale="reciprocal", indifference=0.0, preference=1.0)
    total = F.round(F.col("net") * (F.col("items") - 1) / F.col("items") + F.col("mean_utility"), 12)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(total), "document_id"))
    return flow.withColumn("place", place).where(F.col("place") <= 10).select("query_id", "document_id")


def p6_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Flows of every document of every query over score percentiles, indifferent to differences up to 0.05 and with full
    preference from 0.5 on."""
    flow = net_flow(table(spark, folder, "hybrid_hits"), {"lexical_score": 1.0, "semantic_score": 1.0})
    return flow.select("query_id", "document_id", *(F.round(c, 9).alias(c) for c in ("positive", "negative", "net", "mean_utility")), "items")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids by the public tokenizer."""
    return encode(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of ids and whether they decode to its text."""
    documents = table(spark, folder, "documents")
    encoded = encode(documents)
    back = decode(encoded).withColumnRenamed("text", "decoded").join(encoded.select("doc_id", F.size("ids").alias("n_ids")), "doc_id")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", "n_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items that share a run of at least 12 terms."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))
    return found.where(F.col("distance") == 0).select("doc_id", "item_id")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items of which a passage of 12 terms is in the document with at most one edit, or a whole item of 5 to
    11 terms."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_passages"), least=5)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text that was decoded with a wrong encoding."""
    return wrongly_decoded(table(spark, folder, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with the likeliest chain and the restored text."""
    return wrongly_decoded(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
