"""How distinctive each term of a record is.

Method: term frequency times smoothed logarithmic inverse document frequency. Distinct term-record counts are made where
the records are read; document frequencies come from ``frequencies``; the two are joined back. Length normalisation is
given beside the raw weight (``weight`` divided by the record's number of terms), which leaves a record's own order alone.

At scale the join is the cost, and its keys are as skewed as language is. It is split by an exact bound:

* Terms in more than a ``1 / HEAD_SHARE`` of the records are at most HEAD_SHARE times the mean number of distinct terms
  of a record, however large the collection; their frequencies go to every task (and HEAD_ROWS bounds them once more).
  No hot key is left for the join.
* Of the other terms a record knows bounds before the join: their frequency lies between 1 and the head's. A term whose
  upper bound is under the k-th best lower bound of its record cannot be among the k best and isn't sent. This drops no
  row of the result.

Null, empty and blank texts have no terms and give no rows. Equal scores (to 9 decimals) go to the smaller term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.analysis import terms
from findery.functions.formulas import idf
from findery.llm.frequencies import ngram_frequencies
from findery.sources.scratch import materialize

HEAD_SHARE = 1000
HEAD_ROWS = 200_000
DECIMALS = 9


def best_terms(scored: DataFrame, record: str, k: int) -> DataFrame:
    """The k best terms of each record by rounded score, then term."""
    order = Window.partitionBy(record).orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _idf(total: int, df: float) -> float:
    return math.log(1 + (total - df + 0.5) / (df + 0.5))


def record_terms(records: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``<key>, term, tf, df, length, score, weight, place``: the k most distinctive terms of every record.

    ``score`` is tf × idf rounded to 9 decimals, ``weight`` the same divided by the record's number of terms.
    """
    spark = records.sparkSession
    given = records.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    total = given.count()
    df = materialize(ngram_frequencies(given, text).select("term", F.col("records").alias("df")), "term-df")
    above = max(total // HEAD_SHARE, 1)
    head_rows = df.where(F.col("df") > above).orderBy(F.desc("df"), "term").limit(HEAD_ROWS + 1).collect()
    if len(head_rows) > HEAD_ROWS:  # records of unusual length: keep fewer, all terms of a frequency together
        above = head_rows[HEAD_ROWS]["df"]
        head_rows = [r for r in head_rows if r["df"] > above]
    head = spark.sparkContext.broadcast({r["term"]: r["df"] for r in head_rows})
    kind = dict(given.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {t: (n, _idf(total, n)) for t, n in head.value.items()}
        least, most = _idf(total, above), _idf(total, 1)
        slack = 10.0 ** (1 - DECIMALS)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for at, text_ in zip(keys, texts):
                own = terms(text_)
                rare, known = [], []
                for t, n in Counter(own).items():
                    if (c := common.get(t)) is None:
                        rare.append((n, t))
                    else:
                        known.append((n * c[1], n, t, c[0]))
                lower = sorted([x[0] for x in known] + [n * least for n, _ in rare], reverse=True)
                floor = (lower[k - 1] if len(lower) >= k else -math.inf) - slack
                chosen = [(n, t, d) for s, n, t, d in known if s >= floor] + [(n, t, None) for n, t in rare if n * most >= floor]
                for n, t, d in chosen:
                    for column, value in zip(out, (at, t, n, d, len(own))):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], [key, "term", "tf", "df", "length"])

    candidates = materialize(given.mapInArrow(score, f"`{key}` {kind}, term string, tf bigint, df bigint, length bigint"), "term-candidates")
    joined = candidates.where(F.col("df").isNull()).drop("df").join(df.where(F.col("df") <= above), "term").select(candidates.columns)
    everything = candidates.where(F.col("df").isNotNull()).unionByName(joined)
    value = F.col("tf") * idf(F.lit(total), F.col("df"))
    return best_terms(everything.withColumn("score", F.round(value, DECIMALS)).withColumn("weight", value / F.col("length")), key, k)


def query_terms(answers: DataFrame, queries: DataFrame, k: int = 1, analyzed: Column | None = None) -> DataFrame:
    """``query_id, term, tf, df, score, weight, place``: the k most distinctive terms of every query that has answers.

    Per query and part the row of the greatest generation with a non-null map counts (of several, the latest collected).
    N and df are sums over the parts; a null value counts 0 and terms of df 0 are left out, as are queries without rows,
    without text or without terms.
    """
    from findery.functions.analysis import tokens_col

    rows = answers.where(F.col("document_frequencies").isNotNull() & F.col("query_id").isNotNull())
    last = rows.groupBy("query_id", "shard_id").agg(F.max_by(F.struct("document_count", "document_frequencies"), F.struct("generation", "collected_at", "document_count")).alias("a"))
    totals = last.groupBy("query_id").agg(F.coalesce(F.sum("a.document_count"), F.lit(0)).alias("n"))
    df = last.select("query_id", F.explode("a.document_frequencies").alias("term", "value")).groupBy("query_id", "term").agg(F.sum("value").alias("df")).where(F.col("df") > 0)
    tokens = queries.select("query_id", (tokens_col("query") if analyzed is None else analyzed).alias("tokens")).withColumn("length", F.size("tokens"))
    tf = tokens.select("query_id", "length", F.explode("tokens").alias("term")).groupBy("query_id", "length", "term").agg(F.count("*").alias("tf"))
    value = F.col("tf") * idf(F.col("n"), F.col("df"))
    scored = df.join(totals, "query_id").join(tf, ["query_id", "term"]).withColumn("score", F.round(value, DECIMALS)).withColumn("weight", value / F.col("length"))
    return best_terms(scored, "query_id", k)
