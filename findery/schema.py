"""Schemas of the tables that are kept."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("document_id", T.StringType(), False), T.StructField("text", T.StringType(), False)])
POSTINGS = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("document_id", T.StringType(), False), T.StructField("tf", T.LongType(), False), T.StructField("dl", T.LongType(), False)])
LENGTHS = T.StructType([T.StructField("document_id", T.StringType(), False), T.StructField("dl", T.LongType(), False)])
VECTORS = T.StructType([T.StructField("document_id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType()), False)])
MUTATIONS = T.StructType(
    [
        T.StructField("shard_id", T.IntegerType()),
        T.StructField("generation", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
