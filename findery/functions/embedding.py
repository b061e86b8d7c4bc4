"""Embedders: text to unit vector.

The pretrained model of the service this follows needs a download; here an embedder is anything with an identity and a
column. Two are given: the mean of token vectors from a table, and counts of topic words.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.errors import IdentityMismatch
from findery.functions.analysis import tokens_col
from findery.functions.vectors import l2_normalized


@dataclass(frozen=True)
class Identity:
    """Vectors may be compared only if all five fields agree."""

    implementation: str
    model: str
    revision: str
    dimension: int
    normalization: str = "l2"

    @property
    def fingerprint(self) -> str:
        return f"{self.implementation}:{self.model}@{self.revision}/d{self.dimension}/{self.normalization}"

    def compatible(self, other: Identity) -> bool:
        return self == other

    def require(self, other: Identity) -> None:
        if not self.compatible(other):
            raise IdentityMismatch(f"{other.fingerprint} cannot be compared with {self.fingerprint}")


def fingerprint_col(implementation: Column, model: Column, revision: Column, dimension: Column, normalization: Column) -> Column:
    """The fingerprint from columns."""
    return F.format_string("%s:%s@%s/d%d/%s", implementation, model, revision, dimension, normalization)


class Embedder(Protocol):
    identity: Identity

    def embed(self, documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
        """``<key>, vector`` for every row; ``vector`` is a unit vector or zero."""


@dataclass(frozen=True)
class TopicEmbedder:
    """Dimension i counts the terms of topic i; a constant is the last dimension, so that no vector is zero."""

    topics: tuple[tuple[str, ...], ...]
    constant: float = 0.25

    @property
    def identity(self) -> Identity:
        return Identity("topics", "-".join(t[0] for t in self.topics), "1", len(self.topics) + 1)

    def vector(self, tokens: Column) -> Column:
        def count(topic: tuple[str, ...]) -> Column:
            return F.size(F.filter(tokens, lambda x: x.isin(*topic))).cast("double")

        counts = [count(t) for t in self.topics]
        return l2_normalized(F.array(*counts, F.lit(self.constant)))

    def embed(self, documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
        return documents.select(key, tokens_col(text).alias("tokens")).select(key, self.vector(F.col("tokens")).alias("vector"))


@dataclass(frozen=True)
class TokenTableEmbedder:
    """Mean of the vectors of a text's terms, from a table ``token, vector``; terms without a vector do not count.

    A text without any known term has the zero vector.
    """

    table: DataFrame
    identity: Identity

    def embed(self, documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
        counted = documents.select(key, F.explode(tokens_col(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
        # one row a dimension: sums combine before the shuffle
        parts = counted.join(self.table, "token").select(key, "n", F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
        found = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
        zero = F.array_repeat(F.lit(0.0), self.identity.dimension)
        return documents.select(key).join(found, key, "left").select(key, l2_normalized(F.coalesce("mean", zero)).alias("vector"))


def table_embedder(spark: SparkSession, folder: str, model: str, revision: str) -> TokenTableEmbedder:
    """The embedder of a stored token table ``<folder>/<model>/<revision>`` (Parquet, ``token, vector``).

    The revision is part of the path and of the fingerprint, so vectors of another one are told apart. A folder that is not
    there, an empty table, or vectors of different widths are refused.
    """
    vectors = spark.read.parquet(f"{folder.rstrip('/')}/{model}/{revision}").select("token", F.col("vector").cast("array<double>").alias("vector"))
    least, most = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least is None or least != most or least < 1:
        raise ValueError(f"the token vectors of {model} {revision} must have one width")
    return TokenTableEmbedder(vectors, Identity("table", model, revision, most))


def synthetic_text(seed: Column, vocabulary: list[str], words: int = 40) -> Column:
    """Benchmark text: word i is number ``seed * 7 + i`` of the vocabulary, round and round."""
    table = F.array(*map(F.lit, vocabulary))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.element_at(table, ((seed * 7 + i) % len(vocabulary) + 1).cast("int"))), " ")
