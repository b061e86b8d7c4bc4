"""Semantic search: exact cosine over unit vectors.

Every vector of the index is compared; ``total`` is the number of vectors searched. Zero vectors score 0 and are returned.
Equal scores go to the smaller id. Scores are those of single-precision vectors, summed in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.vectors import dot, l2_normalized, well_formed
from findery.operators import best as packed
from findery.sources.scratch import materialize

#: Query vectors, and vectors, that are multiplied at a time.
QUERY_BLOCK, TILE = 128, 8192


def contains(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """``document_id, embedded`` for every distinct id asked for."""
    have = vectors.select("document_id", F.lit(True).alias("embedded")).distinct()
    return ids.select("document_id").distinct().join(have, "document_id", "left").select("document_id", F.coalesce("embedded", F.lit(False)).alias("embedded"))


def checked_query(vector: Sequence[float], dimension: int) -> list[float]:
    """The query vector, if it is one-dimensional, of the index's width and finite."""
    v = np.asarray(vector, np.float32)
    if v.ndim != 1 or len(v) != dimension or not np.isfinite(v).all():
        raise ValueError(f"a query vector must be {dimension} finite numbers")
    return v.tolist()


def vector_topk(vectors: DataFrame, query: Sequence[float], limit: int, dimension: int, decimals: int | None = None) -> DataFrame:
    """``document_id, score`` of the ``limit`` vectors nearest to one query; ``vectors`` has ``document_id, vector``."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    q = F.array(*(F.lit(float(x)).cast("float") for x in checked_query(query, dimension)))
    score = dot(F.col("vector"), q)
    scored = vectors.where(well_formed(F.col("vector"), dimension)).select("document_id", (score if decimals is None else F.round(score, decimals)).alias("score"))
    return scored.orderBy(F.desc("score"), "document_id").limit(limit)


def batch_topk(vectors: DataFrame | Sequence[DataFrame], queries: DataFrame, limit: int, dimension: int, decimals: int | None = None) -> DataFrame:
    """``query_id, document_id, score, rank``; ``queries`` (``query_id, vector``) are a stated set, taken in passes.

    The queries of a pass are sent to every task and multiplied with its vectors; a task keeps ``limit`` rows a query, and
    these are merged. Products in single precision, with the bound of their error, only tell which rows are worked out in
    double precision. Both sides must be unit vectors. Badly formed vectors and queries are left out. ``vectors`` may be
    those of several shards: no task then has vectors of two.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    shards = [vectors] if isinstance(vectors, DataFrame) else list(vectors)
    spark = shards[0].sparkSession
    asked = queries.where(well_formed(F.col("vector"), dimension)).select("query_id", "vector")
    # a query's row is its number in the packed tables; as floats the vectors are what they were
    ids, matrix = [], np.empty((0, dimension), np.float32)
    for part in _blocks(asked.toLocalIterator()):
        ids += [[r[0]] for r in part]
        matrix = np.concatenate([matrix, np.array([r[1] for r in part], np.float32)])
    good = [v.where(well_formed(F.col("vector"), dimension)).select("document_id", "vector") for v in shards]
    if len(ids) * limit > packed.ROWS_A_PASS:
        good = [materialize(v, "vectors") for v in good]
    parts, names = [], []
    for first, end in packed.passes(len(ids), limit):
        block = first // packed.QUERIES_A_BLOCK
        names.append((block, ids[first:end]))
        sent = spark.sparkContext.broadcast(matrix[first:end])
        for shard in good:
            parts.append(packed.few_tasks(shard, len(shards)).mapInArrow(_task(sent, block, limit, decimals), packed.PACKED))
    if not parts:
        parts.append(spark.createDataFrame([], packed.PACKED))
    return packed.merged(parts, names, limit, decimals).drop("total")


def _task(sent: Broadcast, first_block: int, limit: int, decimals: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares a task's vectors with all queries of a pass."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        wide = np.linalg.norm(asked.astype(float), axis=1)
        kept = packed.Kept(len(asked), limit, decimals)
        for held in packed.together((b.column(0), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows):
            kept.begin(pa.concat_arrays([ids for ids, _ in held]))
            v = np.concatenate([x for _, x in held]).astype(np.float32, copy=False)
            longest = float(np.sqrt(np.einsum("ij,ij->i", v, v, dtype=float).max()))
            # a sum of d products in single precision is off by less than d + 2 units in the last place of the norms' product
            off = 2.0**-23 * (v.shape[1] + 2) * longest * wide
            slack = off + (0.0 if decimals is None else 2 * 10.0**-decimals)
            for first in range(0, len(asked), QUERY_BLOCK):
                here = slice(first, min(len(asked), first + QUERY_BLOCK))
                least = kept.least[here]
                fresh = np.flatnonzero(least == -np.inf)
                # as many vectors at a time as stay near the processor, but all for the first bound
                width = len(v) if fresh.size else TILE
                for left in range(0, len(v), width):
                    s = asked[here] @ v[left : left + width].T
                    if fresh.size:
                        least[fresh] = packed.least_of_best(s[fresh], limit) - off[here][fresh]
                    bound = np.nextafter((least - slack[here]).astype(np.float32), np.float32(-np.inf))
                    chosen = packed.true_at(s >= bound[:, None])
                    if len(chosen) > 4 * limit * len(s):  # the vectors before these were farther
                        least[:] = np.maximum(least, packed.least_of_best(s, limit) - off[here])
                        bound = np.nextafter((least - slack[here]).astype(np.float32), np.float32(-np.inf))
                        chosen = packed.true_at(s >= bound[:, None])
                    if not len(chosen):
                        continue
                    query, at = np.divmod(chosen, s.shape[1])
                    query, at = query + first, at + left
                    score = np.empty(len(chosen))
                    for x in range(0, len(chosen), 1 << 13):
                        some = slice(x, x + (1 << 13))
                        score[some] = np.einsum("ij,ij->i", asked[query[some]].astype(float), v[at[some]].astype(float))
                    if decimals is not None:
                        score = np.round(score, decimals)
                    kept.add(first // packed.QUERIES_A_BLOCK, query, at, score)
        yield from kept.packed(first_block)

    return nearest


def _blocks(rows: Iterator) -> Iterator[list]:
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == 8 * packed.QUERIES_A_BLOCK:
            yield held
            held = []
    if held:
        yield held


def normalized_index(vectors: DataFrame, dimension: int, key: str = "document_id", vector: str = "vector") -> DataFrame:
    """``document_id, vector``: well-formed vectors as unit vectors, zero ones as they are."""
    return vectors.where(well_formed(F.col(vector), dimension)).select(F.col(key).alias("document_id"), l2_normalized(F.col(vector)).alias("vector"))
