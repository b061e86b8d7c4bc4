"""Ranking formulas as Columns. The order of operations is part of the result: floating point depends on it."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from findery.config import BM25Params


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, always positive."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def average_length(n: Column, total: Column) -> Column:
    """Mean document length; 0 for no documents."""
    return F.when(n == 0, F.lit(0.0)).otherwise(total / n)


def bm25(tf: Column, df: Column, length: Column, n: Column, average: Column, params: BM25Params = BM25Params()) -> Column:
    """What one occurrence of a query term adds to a document's score."""
    k1, b = F.lit(float(params.k1)), F.lit(float(params.b))
    return idf(n, df) * (tf * (k1 + 1.0)) / (tf + k1 * (F.lit(1.0) - b + b * (length / average)))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """Reciprocal of constant plus rank; 0 where there is no rank."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def in_order(parts: Column) -> Column:
    """Sum of an array of ``pos, value`` structs in order of position, so that a shuffle cannot change the last bit."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda total, x: total + x["value"])


def register_formulas(spark: SparkSession) -> None:
    """``idf(n, df)`` and ``rrf_term(rank, k)`` as SQL functions, which Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION idf(n BIGINT, df BIGINT) RETURNS DOUBLE RETURN ln(1.0D + (n - df + 0.5D) / (df + 0.5D))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf_term(place INT, k INT) RETURNS DOUBLE RETURN coalesce(1.0D / (k + place), 0.0D)")
