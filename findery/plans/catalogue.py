"""Every query of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from findery.plans import corpora, lexical, retrieval

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return lexical.QUERIES | retrieval.QUERIES | corpora.QUERIES


def oracle_sql() -> dict[str, str]:
    return lexical.sql() | retrieval.sql() | corpora.sql()
