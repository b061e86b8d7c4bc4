"""The one analyzer for documents and queries: NFKC, casefold, maximal runs of alphanumeric characters.

``terms`` is the definition. ``tokens_col`` is the same function as an Arrow UDF, because Spark SQL has neither
compatibility normalisation nor full case folding; it is deterministic, so filters on other columns still reach the scan.

Nulls: ``terms(None)`` is the empty list and ``tokens_col`` of a null is an empty array. A text without a term (blank,
only punctuation) is also an empty array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# `\w` without the underscore is exactly str.isalnum, which the definition names.
_RUNS = re.compile(r"[^\W_]+")


def normalized(text: str) -> str:
    """Compatibility-composed and case-folded text. Plain ASCII needs only lower-casing, which gives the same."""
    return text.lower() if text.isascii() else normalize("NFKC", text).casefold()


def terms(text: str | None) -> list[str]:
    """Terms of a text in order, repeats kept."""
    return _RUNS.findall(normalized(text)) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(terms)


def tokens_col(text: Column | str) -> Column:
    """Terms of a text column as ``array<string>``; null and blank texts give an empty array."""
    return _tokens(text)


def register_analysis(spark: SparkSession) -> None:
    """Make the analyzer callable from SQL as ``analyze(text)``."""
    spark.udf.register("analyze", _tokens)
