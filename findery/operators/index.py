"""The inverted index as tables, and the figures taken from it.

Postings are rows ``term, document_id, tf, dl``; the document length rides along so that scoring needs no second join.
Lengths have a row for every document, also for those without a term, as these count in N and in the mean length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.functions.analysis import terms, tokens_col
from findery.functions.formulas import average_length
from findery.schema import LENGTHS, POSTINGS
from findery.sources.scratch import materialize

#: Of a stored index: files by term, so that a query reads only the buckets of its terms.
BUCKETS = 256


@dataclass(frozen=True)
class InvertedIndex:
    postings: DataFrame
    lengths: DataFrame
    #: How many buckets stored postings are in; 0 if they are not.
    buckets: int = 0

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Write both tables; postings by bucket of the term and sorted within, so that scans prune and skip."""
        bucketed = self.postings.select(POSTINGS.names).withColumn("bucket", bucket(F.col("term"), buckets))
        bucketed.repartition("bucket", F.pmod(F.xxhash64("document_id"), F.lit(16))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")

    @staticmethod
    def load(spark: SparkSession, path: str, buckets: int = BUCKETS) -> InvertedIndex:
        """An index that was saved with so many buckets."""
        postings = spark.read.schema(T.StructType([*POSTINGS.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/postings")
        return InvertedIndex(postings, spark.read.schema(LENGTHS).parquet(f"{path}/lengths"), buckets)

    def lookup(self, words: Sequence[str]) -> DataFrame:
        """Postings of the given terms; unknown terms have none. On a stored index only their buckets are read."""
        chosen = self.postings.where(F.col("term").isin(*sorted(set(words)))) if words else self.postings.where(F.lit(False))
        if self.buckets and words:
            of = self.postings.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "term string").select(bucket(F.col("term"), self.buckets)).distinct().collect()
            chosen = chosen.where(F.col("bucket").isin(*(r[0] for r in of)))
        return chosen.select(POSTINGS.names)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def analyzed(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``document_id, tokens``; a null text is a document without terms."""
    return documents.select(F.col(key).alias("document_id"), tokens_col(text).alias("tokens"))


def build_index(documents: DataFrame, key: str = "document_id", text: str = "text") -> InvertedIndex:
    """Both tables from the texts. Terms are counted where a document is read, so postings need no shuffle."""
    given = documents.select(F.col(key).alias("document_id"), F.col(text).alias("text"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out: tuple[list, ...] = ([], [], [], [])
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = terms(t)
                    counts = Counter(own)
                    out[0].extend(counts.keys())
                    out[1].extend([i] * len(counts))
                    out[2].extend(counts.values())
                    out[3].extend([len(own)] * len(counts))
                yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], POSTINGS.names)

    lengths = analyzed(documents, key, text).select("document_id", F.size("tokens").cast("bigint").alias("dl"))
    return InvertedIndex(given.mapInArrow(post, POSTINGS), lengths)


def counted_index(documents: DataFrame, key: str = "document_id", text: str = "text", along: str | None = None) -> InvertedIndex:
    """Both tables where both are used: the texts are analyzed once, into a written table with a row a document.

    ``along`` is a string column of the documents that both tables are to have.
    """
    return Matches(materialize(counted(documents, key, text, along), "counted")).index()


def counted(documents: DataFrame, key: str = "document_id", text: str = "text", along: str | None = None) -> DataFrame:
    """``document_id, dl, terms, tfs`` of every document, and the column ``along``."""
    given = documents.select(F.col(key).alias("document_id"), F.col(text).alias("text"), *([along] if along else []))
    shape = _COUNTED.replace("document_id string", f"document_id {dict(given.dtypes)['document_id']}") + f", `{along}` string" * bool(along)
    names = ["document_id", "dl", "terms", "tfs"] + [along] * bool(along)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                lengths, words, tfs, ends = [], [], [], [0]
                for own in map(terms, part.column(1).to_pylist()):
                    counts = Counter(own)
                    lengths.append(len(own))
                    words.extend(counts.keys())
                    tfs.extend(counts.values())
                    ends.append(len(words))
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(words, pa.string()), pa.array(tfs, pa.int64())))
                yield pa.record_batch([part.column(0), pa.array(lengths, pa.int64()), *lists, *part.columns[2:]], names)

    return given.mapInArrow(count, shape)


_COUNTED = "document_id string, dl bigint, terms array<string>, tfs array<bigint>"


@dataclass(frozen=True)
class Matches:
    """A row for every document: ``document_id, dl, terms, tfs``, of some terms only."""

    rows: DataFrame

    def index(self) -> InvertedIndex:
        along = [c for c in self.rows.columns if c not in ("document_id", "dl", "terms", "tfs")]
        each = self.rows.select(F.explode(F.arrays_zip("terms", "tfs")).alias("p"), "document_id", "dl", *along)
        return InvertedIndex(each.select(F.col("p.terms").alias("term"), "document_id", F.col("p.tfs").alias("tf"), "dl", *along), self.rows.select("document_id", "dl", *along))


def match(documents: DataFrame, words: Sequence[str], key: str = "document_id", text: str = "text", along: str | None = None) -> Matches:
    """What the given terms match, without a stored index: a single pass over the texts that keeps a small row a document.

    The number of terms is that of the queries asked, not of the corpus. ``along`` is a string column of the documents that
    the rows are to have; they are written apart by it.
    """
    wanted = frozenset(words)
    given = documents.select(F.col(key).alias("document_id"), F.col(text).alias("text"), *([along] if along else []))
    names = ["document_id", "dl", "terms", "tfs"] + [along] * bool(along)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                lengths, found = [], []
                for t in part.column(1).to_pylist():
                    own = terms(t)
                    lengths.append(len(own))
                    found.append(Counter(filter(wanted.__contains__, own)))
                lists = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
                yield pa.record_batch([part.column(0), pa.array(lengths, pa.int64()), *lists, *part.columns[2:]], names)

    return Matches(materialize(given.mapInArrow(seek, _COUNTED + f", `{along}` string" * bool(along)), "matches", [along] if along else None))


def matching(documents: DataFrame, words: Sequence[str], key: str = "document_id", text: str = "text") -> InvertedIndex:
    """An index of the given terms only."""
    return match(documents, words, key, text).index()


def document_frequency(postings: DataFrame) -> DataFrame:
    """``term, df``."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def totals(lengths: DataFrame) -> DataFrame:
    """One row ``n, total_len``, empty documents included."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))


def index_stats(index: InvertedIndex) -> DataFrame:
    """One row ``n, vocabulary, total_tokens, avgdl``."""
    vocabulary = index.postings.agg(F.count_distinct("term").alias("vocabulary"))
    return totals(index.lengths).crossJoin(F.broadcast(vocabulary)).select("n", "vocabulary", F.col("total_len").alias("total_tokens"), average_length(F.col("n"), F.col("total_len")).alias("avgdl"))


def corpus_stats(index: InvertedIndex, words: Sequence[str]) -> DataFrame:
    """``term, df, n, total_len`` for every distinct word asked for; df 0 for an unknown one."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "term string")
    df = document_frequency(index.lookup(words))
    return asked.join(F.broadcast(df), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")).crossJoin(F.broadcast(totals(index.lengths)))


def merge_stats(parts: DataFrame) -> DataFrame:
    """Stats of parts (``n, total_len, term, df`` with a ``part`` column) summed: ``term, df, n, total_len``.

    A part's ``n`` and ``total_len`` stand on each of its rows and count once.
    """
    whole = parts.groupBy("part").agg(F.max("n").alias("n"), F.max("total_len").alias("total_len")).agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
    return parts.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(whole))


def contains(index: InvertedIndex, ids: DataFrame) -> DataFrame:
    """``document_id, indexed`` for every distinct id asked for."""
    have = index.lengths.select("document_id", F.lit(True).alias("indexed"))
    return ids.select("document_id").distinct().join(have, "document_id", "left").select("document_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))
