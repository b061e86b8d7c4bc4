"""Lexical search: BM25 over an inverted index.

Contributions are summed in the order of the query's terms, so scores do not depend on partitions; equal scores go to the
smaller id. A repeated query term counts as often as it occurs, an unknown one adds nothing. A query without terms has no
hits and a total of 0. Empty documents count in N and the mean length and never match.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.config import BM25Params
from findery.functions.analysis import terms, tokens_col
from findery.functions.formulas import average_length, bm25, in_order
from findery.operators import best as packed
from findery.operators.index import InvertedIndex, Matches, document_frequency, totals
from findery.sources.scratch import materialize

#: Query terms (rows) up to this number are sent to every task; more are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Of so many terms at most a task holds a value for each document that it scores at a time.
SPREAD_TERMS = 128


def query_terms(spark: SparkSession, queries: dict[int, str] | dict[int, Sequence[str]]) -> DataFrame:
    """``query_id, pos, term`` of queries given as texts or as analyzed terms."""
    rows = [(q, pos, t) for q, text in queries.items() for pos, t in enumerate(terms(text) if isinstance(text, str) else text)]
    return spark.createDataFrame(rows, "query_id bigint, pos int, term string")


def query_table_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """``query_id, pos, term`` of a table of queries; nulls and blanks have none."""
    return queries.select(F.col(key).alias("query_id"), F.posexplode(tokens_col(text)).alias("pos", "term"))


def score(index: InvertedIndex, asked: DataFrame, params: BM25Params = BM25Params(), stats: DataFrame | None = None) -> DataFrame:
    """``query_id, document_id, score`` of every match of ``asked`` (``query_id, pos, term``).

    ``stats`` (``term, df, n, total_len``) overrides the index's own figures: a shard scores with those of all shards.
    """
    asked = materialize(asked.select("query_id", "pos", "term"), "query-terms")
    small = asked.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else lambda df: df
    words = asked.select("term").distinct()
    hits = index.postings.join(hint(words), "term", "left_semi").select("term", "document_id", "tf", "dl")
    if stats is None:
        stats = document_frequency(hits).crossJoin(F.broadcast(totals(index.lengths)))
    weighted = asked.join(hint(stats), "term").withColumn("avgdl", average_length(F.col("n"), F.col("total_len"))).where((F.col("n") > 0) & (F.col("avgdl") > 0))
    value = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), params)
    parts = hits.join(hint(weighted), "term").select("query_id", "document_id", F.struct("pos", value.alias("value")).alias("part"))
    # a group has at most as many parts as the query has terms
    return parts.groupBy("query_id", "document_id").agg(in_order(F.collect_list("part")).alias("score"))


def batch_topk(matches: Matches | Sequence[Matches], asked: DataFrame, limit: int, params: BM25Params = BM25Params(), decimals: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``query_id, document_id, score, rank, total``: the first ``limit`` of each query of a stated set, scored where the
    documents are.

    The queries' terms (at most BROADCAST_TERMS rows, else ``score`` is to be used) go to every task. A document's matches
    are one row, so a task sums a query's contributions in the order of its terms without a shuffle and sends on only its
    own best of each query, with the number of its matches; ``total`` is their sum. Queries without a match have no row.
    Queries of the same terms are scored once. ``matches`` may be of several shards: no task then has documents of two.
    ``stats`` is as in ``score``.
    """
    parts, names = _scored(matches, asked, limit, params, decimals, stats)
    return packed.merged(parts, names, limit, decimals)


def batch_totals(matches: Matches | Sequence[Matches], asked: DataFrame) -> DataFrame:
    """``query_id, total``: matches of each query that has one, in several rows that are to be summed. Nothing is scored."""
    return packed.summed(*_scored(matches, asked, 0))


def _scored(matches: Matches | Sequence[Matches], asked: DataFrame, limit: int, params: BM25Params = BM25Params(), decimals: int | None = None, stats: DataFrame | None = None) -> tuple[list[DataFrame], list]:
    """What ``best.merged`` takes."""
    spark = asked.sparkSession
    shards = [matches] if isinstance(matches, Matches) else list(matches)
    rows = asked.select("query_id", "pos", "term").limit(BROADCAST_TERMS + 1).collect()
    if len(rows) > BROADCAST_TERMS:
        raise ValueError(f"there are more than {BROADCAST_TERMS} query terms")
    if stats is None:
        lengths, postings = ([getattr(s.index(), name) for s in shards] for name in ("lengths", "postings"))
        n, total_len = totals(reduce(DataFrame.unionByName, lengths)).first()
        frequency = dict(map(tuple, document_frequency(reduce(DataFrame.unionByName, postings)).collect()))  # of query terms only
    else:
        known = stats.select("term", "df", "n", "total_len").collect()
        n, total_len = (known[0]["n"], known[0]["total_len"]) if known else (0, 0)
        frequency = {r["term"]: r["df"] for r in known}
    by_query: dict[int, list[str]] = {}
    for q, _, t in sorted(map(tuple, rows)):
        if t in frequency:
            by_query.setdefault(q, []).append(t)
    number = {t: i for i, t in enumerate(sorted({t for own in by_query.values() for t in own}))}
    weights = np.array([math.log(1.0 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in number])
    same: dict[tuple[int, ...], list[int]] = {}
    for q, own in by_query.items():
        same.setdefault(tuple(number[t] for t in own), []).append(q)
    queries, known_as = list(same), list(same.values())
    average = total_len / n if n else 0.0
    parts, names = [], []
    for first, end in packed.passes(len(queries), limit):
        block = first // packed.QUERIES_A_BLOCK
        sent = spark.sparkContext.broadcast((queries[first:end], number, weights, average))
        names.append((block, known_as[first:end]))
        for shard in shards:
            task = _task(sent, block, limit, decimals, params)
            parts.append(packed.few_tasks(shard.rows.select("document_id", "dl", "terms", "tfs"), len(shards)).mapInArrow(task, packed.PACKED))
    if not parts:
        parts.append(spark.createDataFrame([], packed.PACKED))
    return parts, names


def _task(sent: Broadcast, first_block: int, limit: int, decimals: int | None, params: BM25Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores, or for a limit of 0 counts, a task's documents for all queries of a pass."""
    k1, b = params.k1, params.b
    slack = 0.0 if decimals is None else 2 * 10.0**-decimals

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, number, idf, average = sent.value
        kept = packed.Kept(len(queries), limit, decimals)
        small = np.uint16 if len(number) < 1 << 16 else np.int32

        def compact(batch: pa.RecordBatch) -> tuple:
            """Ids, and of every posting its term, document and value: all that is held of several batches."""
            lists = batch.column(2)
            words = lists.flatten().dictionary_encode()
            code = words.indices.to_numpy()
            of = np.array([number.get(w, -1) for w in words.dictionary.to_pylist()], np.int32)
            document = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
            value = np.ones(len(code), bool)
            if limit and len(of):
                tf = batch.column(3).flatten().to_numpy().astype(float)
                value = idf[of][code] * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * (batch.column(1).to_numpy()[document] / average)))
            term = of[code]
            if len(of) and of.min() < 0:
                term, document, value = (x[term >= 0] for x in (term, document, value))
            return batch.column(0), term.astype(small), document, value

        for held in packed.together(map(compact, batches), packed.CHUNK // 2):
            firsts = np.cumsum([0, *(len(ids) for ids, *_ in held)])
            n = int(firsts[-1])
            term, value = (np.concatenate([x[i] for x in held]) for i in (1, 3))
            document = np.concatenate([x[2] + np.int32(first) for x, first in zip(held, firsts)])
            if not len(term):
                continue
            if limit:
                kept.begin(pa.concat_arrays([ids for ids, *_ in held]))
            held.clear()
            size = np.bincount(term, minlength=len(number))
            start = np.cumsum(size) - size
            order = np.argsort(term, kind="stable")
            document, value = document[order], value[order]
            del term, order
            # the values of the most frequent terms are held for every document, 0 where it has none
            spread: dict[int, np.ndarray] = {}
            for t in np.argsort(-size, kind="stable")[:SPREAD_TERMS].tolist():
                if size[t] * 8 > n:
                    spread[t] = np.zeros(n, value.dtype)
                    spread[t][document[start[t] : start[t] + size[t]]] = value[start[t] : start[t] + size[t]]
            sizes, starts, score = size.tolist(), start.tolist(), np.zeros(n, value.dtype)
            for block in range(0, len(queries), packed.QUERIES_A_BLOCK):
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, own in enumerate(queries[block : block + packed.QUERIES_A_BLOCK], block):
                    present = [t for t in own if sizes[t]]
                    if not present:
                        continue
                    few = sum(sizes[t] for t in present) * 8 <= n
                    if not few:
                        score[:] = 0
                    for t in present:
                        if t in spread:
                            np.add(score, spread[t], out=score)
                        else:
                            here = slice(starts[t], starts[t] + sizes[t])
                            score[document[here]] += value[here]
                    if few:
                        where = [document[starts[t] : starts[t] + sizes[t]] for t in present]
                        at = where[0] if len(present) == 1 else np.unique(np.concatenate(where))
                        kept.matches[q] += len(at)
                        own_scores = score[at]
                        score[at] = 0
                    else:
                        kept.matches[q] += np.count_nonzero(score if not limit else score > 0)
                        at, own_scores = None, score
                    if not limit:
                        continue
                    least = kept.least[q]
                    if least == -np.inf:
                        least = kept.least[q] = packed.least_of_best(own_scores[None], limit)[0]
                    passing = own_scores >= least - slack
                    chosen = np.flatnonzero(passing) if at is not None else packed.true_at(passing)
                    if at is None:
                        chosen = chosen[score[chosen] > 0]
                    if len(chosen) > 4 * limit:  # the documents before these were of lesser scores
                        least = kept.least[q] = max(least, packed.least_of_best(own_scores[None], limit)[0])
                        chosen = chosen[own_scores[chosen] >= least - slack]
                    if len(chosen):
                        found.append((q, chosen if at is None else at[chosen], own_scores[chosen]))
                if found:
                    kept.add(block // packed.QUERIES_A_BLOCK, np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found]))
        yield from kept.packed(first_block)

    return rank


def best(scored: DataFrame, limit: int, decimals: int | None = None) -> DataFrame:
    """The first ``limit`` of each query by score, then id, with ``rank``. ``decimals`` rounds before the comparison."""
    by: Column = F.col("score") if decimals is None else F.round("score", decimals)
    order = Window.partitionBy("query_id").orderBy(by.desc(), "document_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def match_totals(scored: DataFrame, query_ids: DataFrame) -> DataFrame:
    """``query_id, total`` for every query, also for those without a match."""
    counts = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    return query_ids.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def with_text(hits: DataFrame, documents: DataFrame, limit_rows: int = 100_000) -> DataFrame:
    """Hits with their text, joined last; a few hits are broadcast, more are joined by shuffle."""
    hits = materialize(hits, "hits")
    side = F.broadcast(hits) if hits.count() <= limit_rows else hits
    return documents.select("document_id", "text").join(side, "document_id").select(*hits.columns, "text")
