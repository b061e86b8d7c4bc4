"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned and filters pushed down by whoever uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
