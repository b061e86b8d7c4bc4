"""How often every n-gram of terms occurs, and in how many records.

Method: a suffix array with common-prefix intervals. Each block of whole records is one token sequence, whose suffixes end
with their record. ``SuffixArray`` sorts them to full depth by prefix doubling: the ranks by the first 1, 2, 4, ... tokens
are kept, and only suffixes that are not told apart yet are sorted again. Two suffixes' common prefix comes from the kept
ranks by binary descent; those of neighbours are the array of common prefixes. The suffixes that share their first n tokens
are an interval of the array, between two places where the common prefix is shorter than n, and its length is the number of
occurrences. Of the suffixes of one record, two that follow each other in the array are a duplicate adjacency; its common
prefix tells in which intervals both lie. Occurrences less duplicate adjacencies is the number of records. This holds for
every n; ``max_n`` bounds which are given, and None gives all of them, to the longest record, whose number grows with the
square of a record's length.

A record is never split between blocks, hence the figures of the blocks add up exactly, and Spark sums them with partial
aggregation before the only shuffle. A term that fills a third of all records is one row per block there. Memory follows the
tokens of a block, about BLOCK_TOKENS, or those of one record that has more.

Nulls: a null text has no terms and is not counted as a record. Empty and blank texts are records without terms. Repeated
records count as often as they come. An empty table gives an empty table. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions.analysis import terms

#: A block is complete with so many tokens. More give fewer rows to merge; memory follows them, at about 100 bytes each.
BLOCK_TOKENS = 1 << 20
#: Rows of a batch that is given.
BATCH_ROWS = 100_000


class SuffixArray:
    """``order``: the suffixes' start positions, sorted; equal ones by position. ``tokens`` are the numbers of all records'
    tokens one after another, ``lengths`` how many each record has."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        n = len(tokens)
        self.record = np.repeat(np.arange(len(lengths)), lengths)
        self.end = np.repeat(np.cumsum(lengths), lengths)
        left = self.end - np.arange(n)
        self.order = np.argsort(tokens, kind="stable")
        rank, first = self._ranks(tokens[self.order], np.arange(n))
        at = np.empty(n, np.int32)
        at[self.order] = rank
        self.levels = [at]
        depth = 1
        while True:
            # neither told apart from both neighbours nor known to be equal to the end
            single = first & np.append(first[1:], True)
            open_ = np.flatnonzero(~single & (left[self.order] >= depth))
            if not len(open_):
                return
            suffix = self.order[open_]
            beyond = suffix + depth
            following = np.where(beyond < self.end[suffix], at[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
            key = at[suffix].astype(np.int64) * (n + 1) + following
            sorted_ = np.argsort(key, kind="stable")
            suffix = suffix[sorted_]
            self.order[open_] = suffix
            rank, starts = self._ranks(key[sorted_], open_)
            at = at.copy()
            at[suffix] = rank
            first[open_] = starts
            self.levels.append(at)
            depth *= 2

    @staticmethod
    def _ranks(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first of each run of equal keys, and which are first."""
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(first, places, 0)), first

    def common_prefix(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Tokens that the suffixes at ``a`` and ``b``, which are not the same, share at their beginning; where these are more than
        ``most``, any number beyond it."""
        a, b, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        end_a, end_b, last = self.end[a], self.end[b], len(self.end) - 1
        for level in range(min(len(self.levels), max(most, 1).bit_length()) - 1, -1, -1):
            rank = self.levels[level]
            same = (a < end_a) & (b < end_b) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
            step = np.where(same, np.minimum(1 << level, end_a - a), 0)  # equal suffixes may be shorter
            a, b, shared = a + step, b + step, shared + step
        return shared


def intervals(tokens: np.ndarray, lengths: np.ndarray, max_n: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 .. max_n: n, a start position of every distinct n-gram, its occurrences and its number of records.

    No n-gram crosses a record's end. ``max_n`` None goes on to the longest record.
    """
    longest = int(lengths.max(initial=0))
    deepest = longest if max_n is None else min(max_n, longest)
    if not deepest:
        return
    array = SuffixArray(tokens, lengths)
    order = array.order
    left = array.end[order] - order
    common = np.zeros(len(order), np.int64)
    common[1:] = array.common_prefix(order[:-1], order[1:], deepest)
    # of each record's suffixes, with the one before it in the array
    owner = array.record[order]
    by_record = np.argsort(owner, kind="stable")
    follows = np.flatnonzero(owner[by_record[1:]] == owner[by_record[:-1]]) + 1
    duplicate = np.zeros(len(order), np.int64)
    duplicate[by_record[follows]] = array.common_prefix(order[by_record[follows - 1]], order[by_record[follows]], deepest)
    for n in range(1, deepest + 1):
        fits = left >= n
        first = np.flatnonzero(fits & (common < n))
        occurrences = np.add.reduceat(fits, first, dtype=np.int64)
        yield n, order[first], occurrences, occurrences - np.add.reduceat(fits & (duplicate >= n), first, dtype=np.int64)


def _rows(parts: list[np.ndarray], words: list[str], max_n: int | None) -> Iterator[pa.RecordBatch]:
    """The counts of one block of records."""
    tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
    lengths = np.array([len(p) for p in parts], np.int64)
    for n, at, occurrences, records in intervals(tokens, lengths, max_n):
        for i in range(0, len(at), BATCH_ROWS):
            some = slice(i, i + BATCH_ROWS)
            rows = tokens[at[some][:, None] + np.arange(n)].tolist()
            grams = [words[r[0]] for r in rows] if n == 1 else [" ".join([words[t] for t in r]) for r in rows]
            yield pa.record_batch([pa.array(grams, pa.string()), pa.array(np.full(len(grams), n, np.int32)), pa.array(occurrences[some]), pa.array(records[some])], ["term", "n", "occurrences", "records"])


def ngram_frequencies(records: DataFrame, text: str = "text", max_n: int | None = 1) -> DataFrame:
    """``term, n, occurrences, records`` of every distinct n-gram of terms, n up to ``max_n``; terms joined by a blank."""
    if max_n is not None and max_n < 1:
        raise ValueError("max_n must be at least 1")
    block_tokens = BLOCK_TOKENS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: defaultdict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        parts, held = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = terms(t)
                parts.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
                held += len(own)
                if held >= block_tokens:
                    yield from _rows(parts, list(ids), max_n)
                    parts, held = [], 0
                    ids.clear()
        yield from _rows(parts, list(ids), max_n)

    blocks = records.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "term string, n int, occurrences bigint, records bigint")
    return blocks.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def map_frequencies(answers: DataFrame, part: str = "shard_id", version: str = "generation", counts: str = "document_frequencies") -> DataFrame:
    """``term, records`` over all parts: per part and key the non-null value of the greatest version that gives one, summed.

    Null maps, null values and rows with a null version give nothing; repeated rows change nothing.
    """
    latest = (
        answers.where(F.col(version).isNotNull())
        .select(F.col(part).alias("part"), F.col(version).alias("version"), F.explode(counts).alias("term", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("part", "term")
        .agg(F.max(F.struct("version", "value")).alias("last"))
    )
    return latest.groupBy("term").agg(F.sum("last.value").alias("records"))


def map_record_count(answers: DataFrame, part: str = "shard_id", version: str = "generation", count: str = "document_count") -> DataFrame:
    """One row ``total``: per part the count of its greatest version, summed. 0 where there is none."""
    last = answers.where(F.col(version).isNotNull()).groupBy(part).agg(F.max(F.struct(F.col(version), F.col(count))).alias("last"))
    return last.agg(F.coalesce(F.sum(F.col("last")[count]), F.lit(0)).alias("total"))


def mark(records: Column, total: Column, rare_at_most: int = 2, common_above: float = 0.2) -> Column:
    """'rare', 'common' or null; rare goes first."""
    return F.when(records <= rare_at_most, "rare").when(records > total * F.lit(common_above), "common")
