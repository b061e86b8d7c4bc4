"""Integrity checks as tables of violations; an empty table means all is well. No rule is checked on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.vectors import finite, norm, NORM_TOLERANCE
from findery.operators.index import InvertedIndex, counted_index


def _rule(df: DataFrame, rule: str, subject: str = "document_id") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def index_violations(index: InvertedIndex, expected_total: int | None = None) -> DataFrame:
    """``rule, subject`` of an index's tables.

    Rules: a posting's document is unknown; a term frequency is under 1; a length is negative; a length differs from the
    sum of term frequencies (also when postings are missing); a document or a posting is there twice; a posting's own
    length differs; the total differs from the one expected.
    """
    p, lengths = index.postings, index.lengths
    summed = p.groupBy("document_id").agg(F.sum("tf").alias("summed"), F.min("dl").alias("least"), F.max("dl").alias("most"))
    both = lengths.join(summed, "document_id", "full_outer")
    rules = [
        _rule(both.where(F.col("dl").isNull()), "unknown document"),
        _rule(p.where(F.col("tf") < 1), "term frequency", "term"),
        _rule(lengths.where(F.col("dl") < 0), "negative length"),
        _rule(both.where(F.col("dl").isNotNull() & (F.col("dl") != F.coalesce("summed", F.lit(0)))), "length"),
        _rule(both.where((F.col("least") != F.col("dl")) | (F.col("most") != F.col("dl"))), "length of a posting"),
        _rule(lengths.groupBy("document_id").count().where(F.col("count") > 1), "document twice"),
        _rule(p.groupBy("term", "document_id").count().where(F.col("count") > 1), "posting twice", "term"),
    ]
    if expected_total is not None:
        rules.append(_rule(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).where(F.col("total") != expected_total), "total", "total"))
    return reduce(DataFrame.unionByName, rules)


def vector_violations(vectors: DataFrame, dimension: int) -> DataFrame:
    """``rule, subject`` of stored vectors: null, of another width, not finite, of a norm neither 0 nor 1, twice."""
    v = F.col("vector")
    rule = (
        F.when(v.isNull(), "null")
        .when(F.size(v) != dimension, "width")
        .when(~finite(v), "not finite")
        .when((norm(v) != 0) & (F.abs(norm(v) - 1) > NORM_TOLERANCE), "norm")
    )
    each = vectors.select(rule.alias("rule"), F.col("document_id").cast("string").alias("subject")).where(F.col("rule").isNotNull())
    return each.unionByName(_rule(vectors.groupBy("document_id").count().where(F.col("count") > 1), "vector twice"))


def engine_violations(documents: DataFrame, index: InvertedIndex, vectors: DataFrame | None = None, generations: tuple[int, int] | None = None) -> DataFrame:
    """``rule, subject`` across a corpus and what is derived from it.

    Every document has its length and postings as the analyzer gives them, and nothing else has; the same for vectors, if
    any; ``generations`` of store and derived state are equal.
    """
    fresh = counted_index(documents)
    ids = lambda df: df.select("document_id").distinct()
    rules = [
        _rule(ids(documents).join(ids(index.lengths), "document_id", "left_anti"), "not indexed"),
        _rule(ids(index.lengths).join(ids(documents), "document_id", "left_anti"), "indexed without a document"),
        _rule(fresh.lengths.exceptAll(index.lengths.select("document_id", "dl")), "stale length"),
        _rule(fresh.postings.select("document_id", "term", "tf").exceptAll(index.postings.select("document_id", "term", "tf")), "stale posting"),
    ]
    if vectors is not None:
        rules += [
            _rule(ids(documents).join(ids(vectors), "document_id", "left_anti"), "without a vector"),
            _rule(ids(vectors).join(ids(documents), "document_id", "left_anti"), "vector without a document"),
        ]
    if generations and generations[0] != generations[1]:
        spark = documents.sparkSession
        rules.append(spark.createDataFrame([("generation", f"{generations[0]} != {generations[1]}")], "rule string, subject string"))
    return reduce(DataFrame.unionByName, rules)
