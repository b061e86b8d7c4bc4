"""The best rows of each of many queries, where all documents are scored for all queries.

A task keeps the best of its own documents in numpy arrays, and a bound that a row must reach for each query; it passes them
on as one packed table for each block of queries, so that a shuffle moves a few compressed rows and sorts none. The blocks'
tables are merged by whoever gets a block. What a task keeps is bounded by taking the queries in passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a task keeps, over all queries of a pass, and queries whose rows are packed and merged together.
ROWS_A_PASS, QUERIES_A_BLOCK = 1 << 21, 1024
#: Documents that are scored at a time.
CHUNK = 1 << 15

PACKED = "block int, best binary, matches binary"
RANKED = "query_id bigint, document_id string, score double, rank int, total bigint"


def passes(count: int, limit: int) -> Iterator[tuple[int, int]]:
    """First and end of the queries (numbers from 0) of each pass."""
    size = max(1, ROWS_A_PASS // max(1, limit) // QUERIES_A_BLOCK) * QUERIES_A_BLOCK
    for first in range(0, count, size):
        yield first, min(count, first + size)


def few_tasks(rows: DataFrame, parts: int = 1) -> DataFrame:
    """``rows``, one of so many parts, in no more tasks than run at once: each task passes on its own best."""
    return rows.coalesce(max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // parts)))


def together(parts: Iterator[tuple], documents: int = CHUNK) -> Iterator[list[tuple]]:
    """Parts, each of which begins with its ids, until they are of about so many documents."""
    held: list[tuple] = []
    for p in parts:
        if len(p[0]):
            held.append(p)
        if sum(len(x[0]) for x in held) >= documents:
            yield held
            held = []
    if held:
        yield held


def true_at(mask: np.ndarray) -> np.ndarray:
    """Where a contiguous array of bools is true, of which few are: eight are looked at together."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    near = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def least_of_best(scores: np.ndarray, limit: int) -> np.ndarray:
    """A lower bound of the ``limit`` th highest of each row, near to it: that of the maxima of disjoint groups."""
    n = scores.shape[1]
    if n <= limit:
        return np.full(len(scores), -np.inf)
    groups = min(n, max(4 * limit, 256))
    deep = n // groups
    highest = scores[:, : deep * groups].reshape(len(scores), deep, groups).max(axis=1)
    return np.partition(highest, groups - limit, axis=1)[:, groups - limit].astype(float)


class Kept:
    """A task's best rows of each query (numbers from 0) so far, and the number of matches of each."""

    def __init__(self, count: int, limit: int, decimals: int | None) -> None:
        self.limit, self.decimals = limit, decimals
        blocks = -(-count // QUERIES_A_BLOCK)
        self.parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(blocks)]
        self.held, self.bound = [0] * blocks, [2 * QUERIES_A_BLOCK * limit] * blocks
        #: What a score must reach, but for rounding.
        self.least, self.matches = np.full(count, -np.inf), np.zeros(count, np.int64)
        self.ids, self.first, self.place = pa.array([], pa.string()), 0, np.empty(0, np.int32)

    def begin(self, ids: pa.Array) -> None:
        """The documents that are scored next."""
        self.first = len(self.ids)
        self.ids = pa.concat_arrays([self.ids, ids.cast(pa.string())])
        self.place = np.empty(len(self.ids), np.int32)
        self.place[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids), dtype=np.int32)

    def add(self, block: int, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Rows of queries of one block; ``at`` is the document's position among those scored now."""
        self.parts[block].append((query.astype(np.int32), (at + self.first).astype(np.int32), score))
        self.held[block] += len(query)
        if self.held[block] > self.bound[block]:
            self._cut(block)
            self.bound[block] = max(self.bound[block], 2 * self.held[block])

    def _cut(self, block: int) -> tuple[np.ndarray, ...]:
        query, at, score = (np.concatenate([p[i] for p in self.parts[block]]) for i in range(3))
        first = block * QUERIES_A_BLOCK
        chosen = among_first(query - first, self.place[at], score, self.limit, self.decimals)
        query, at, score = rows = query[chosen], at[chosen], score[chosen]
        lowest = np.full(QUERIES_A_BLOCK, np.inf)
        np.minimum.at(lowest, query - first, score)
        full = np.flatnonzero(np.bincount(query - first, minlength=QUERIES_A_BLOCK) == self.limit)
        self.least[first + full] = np.maximum(self.least[first + full], lowest[full])
        self.parts[block], self.held[block] = [rows], len(query)
        return rows

    def packed(self, first_block: int) -> Iterator[pa.RecordBatch]:
        """A row a block; blocks are numbered from ``first_block``."""
        for block in range(len(self.parts)):
            here = self.matches[block * QUERIES_A_BLOCK : (block + 1) * QUERIES_A_BLOCK]
            table = pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.float64())], ["query", "document_id", "score"])
            if self.held[block]:
                query, at, score = self._cut(block)
                self.parts[block] = []
                table = pa.record_batch([pa.array(query), self.ids.take(pa.array(at)), pa.array(score)], table.schema.names)
            elif not here.any():
                continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(table)
            yield pa.record_batch([pa.array([first_block + block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([here.tobytes()], pa.binary())], ["block", "best", "matches"])


def among_first(query: np.ndarray, place: np.ndarray, score: np.ndarray, limit: int, decimals: int | None) -> np.ndarray:
    """Indices of the same rows as ``first_of_each`` gives, in any order; queries are those of a block."""
    counts = np.bincount(query, minlength=QUERIES_A_BLOCK)
    most = int(counts.max(initial=0))
    if most <= limit:
        return np.argsort(query.astype(np.uint16), kind="stable")
    many = counts > max(2 * limit, 4 * len(query) / np.count_nonzero(counts))
    if many.any():  # the few queries that have far more rows than the others
        own, others = np.flatnonzero(many[query]), np.flatnonzero(~many[query])
        first = own[first_of_each(query[own], place[own], score[own], limit, decimals)]
        if not len(others):
            return first
        return np.concatenate([first, others[among_first(query[others], place[others], score[others], limit, decimals)]])
    order = np.argsort(query.astype(np.uint16), kind="stable")
    of = query[order]
    compared = score[order] if decimals is None else np.round(score[order], decimals)
    across = np.full((QUERIES_A_BLOCK, most), -np.inf)
    across[of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]] = compared
    least = np.partition(across, most - limit, axis=1)[:, most - limit][of]
    above, tied = compared > least, np.flatnonzero(compared == least)
    free = limit - np.bincount(of[above], minlength=QUERIES_A_BLOCK)
    tied = tied[np.lexsort((place[order[tied]], of[tied]))]
    turn = np.arange(len(tied)) - np.searchsorted(of[tied], of[tied])
    above[tied[turn < free[of[tied]]]] = True
    return order[above]


def first_of_each(query: np.ndarray, place: np.ndarray, score: np.ndarray, limit: int, decimals: int | None) -> np.ndarray:
    """Indices of the first ``limit`` rows of each query by score, then place, in that order."""
    compared = score if decimals is None else np.round(score, decimals)
    order = np.lexsort((place, -compared, query))
    of = query[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, int)
    position = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
    return order[position < limit]


def merged(parts: Sequence[DataFrame], names: Sequence[tuple[int, Sequence[Sequence[int]]]], limit: int, decimals: int | None) -> DataFrame:
    """``RANKED`` from the packed rows of all passes.

    ``names`` has for each pass the number of its first block, and for each of its queries the ids that it goes by.
    """
    spark = parts[0].sparkSession
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sent = spark.sparkContext.broadcast({first + i: own[i * QUERIES_A_BLOCK : (i + 1) * QUERIES_A_BLOCK] for first, own in names for i in range(-(-len(own) // QUERIES_A_BLOCK))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for block, best, matches in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(block, []).append((best, matches))
        for block in sorted(got):
            packed, known = got.pop(block), sent.value[block]
            totals = sum(np.frombuffer(m, np.int64) for _, m in packed)
            table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x, _ in packed]).combine_chunks()
            query, score = table["query"].to_numpy() % QUERIES_A_BLOCK, table["score"].to_numpy()
            place = np.empty(len(query), np.int32)
            place[pc.sort_indices(table["document_id"]).to_numpy()] = np.arange(len(query), dtype=np.int32)
            chosen = among_first(query, place, score, limit, decimals)
            chosen = chosen[first_of_each(query[chosen], place[chosen], score[chosen], limit, decimals)]
            query = query[chosen]
            starts = np.searchsorted(query, query)
            rank = np.arange(len(query)) - starts + 1
            # a query's rows once for each id that it goes by
            times = np.array([len(k) for k in known], np.int64)[query]
            row = np.repeat(np.arange(len(query)), times)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            flat = np.array([i for k in known for i in k], np.int64)
            before = np.cumsum([0, *(len(k) for k in known)])
            ids = table["document_id"].take(pa.array(chosen[row])).combine_chunks()
            yield pa.record_batch(
                [pa.array(flat[before[query[row]] + turn]), ids, pa.array(score[chosen[row]]), pa.array(rank[row].astype(np.int32)), pa.array(totals[query[row]])],
                ["query_id", "document_id", "score", "rank", "total"],
            )

    return every.repartition("block").mapInArrow(merge, RANKED)


def summed(parts: Sequence[DataFrame], names: Sequence[tuple[int, Sequence[Sequence[int]]]]) -> DataFrame:
    """``query_id, total`` from the packed rows of all passes: the matches of every query that has one, a row a task."""
    spark = parts[0].sparkSession
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sent = spark.sparkContext.broadcast({first + i: own[i * QUERIES_A_BLOCK : (i + 1) * QUERIES_A_BLOCK] for first, own in names for i in range(-(-len(own) // QUERIES_A_BLOCK))})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, matches in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(i, n) for own, n in zip(sent.value[block], np.frombuffer(matches, np.int64).tolist()) if n for i in own]
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["query_id", "total"])

    return every.select("block", "matches").mapInArrow(spread, "query_id bigint, total bigint")
