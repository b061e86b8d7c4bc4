"""Evaluation passages that appear in training texts.

Method: pigeonhole edit matching. A passage is a run of ``window`` consecutive terms of an evaluation item, or a whole item
of fewer terms, but at least ``least``. With an error budget of e, a passage of full length split into e + 1 pieces has at
least one piece that occurs exactly wherever the passage occurs with at most e edits; a shorter one is sought exactly. All
pieces of all passages are looked up at once in a document's runs of terms, by 64-bit hashes in a sorted array, and the
surroundings of each hit are verified with Myers' bit-parallel edit distance over terms, many at a time. A record that
contains a passage within the budget is a leak of the item; ``distance`` is the least over the item's passages (0: the run
itself). Terms are compared as 64-bit hashes.

A passage that many items share, such as a template, is one passage, verified once wherever a piece of it is hit; items come
in only for what is found.

The items are a stated query set against all records: they are taken in blocks of at most BLOCK_CHARACTERS, each a
broadcast of flat arrays of about 15 bytes a character, so any number of items is possible; the benchmark has one block.
Records are never shuffled, and are read once a block.

Null texts, and items of fewer than ``least`` terms (``window``, unless given), are in no result. Items published twice are
reported under each id. Repeated records are reported as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from findery.functions.analysis import terms
from findery.llm.near_duplicates import TermHashes, shingle_hashes

BLOCK_CHARACTERS = 8_000_000
#: Records looked at together, and candidates verified together.
_RECORDS, _CANDIDATES = 512, 50_000


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text``, one bit-parallel step a term of the text."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, p in enumerate(pattern):
        at[p] = at.get(p, 0) | 1 << i
    plus, minus, score = full, 0, m
    best = m
    for t in text:
        eq = at.get(t, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & full  # a match may begin anywhere
        hn = hn << 1 & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        best = min(best, score)
    return best


def myers_many(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """``myers`` for each row of ``patterns`` (of at most 64 terms) and of ``texts``."""
    count, m = patterns.shape
    one, full = np.uint64(1), np.uint64((1 << m) - 1)
    bit, high = one << np.arange(m, dtype=np.uint64), one << np.uint64(m - 1)
    plus, minus, score = np.full(count, full), np.zeros(count, np.uint64), np.full(count, m)
    best = score.copy()
    for t in texts.T:
        eq = np.where(patterns == t[:, None], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
        score = score + ((hp & high) != 0) - ((hn & high) != 0)
        hp, hn = hp << one & full, hn << one & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        best = np.minimum(best, score)
    return best


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where the values of each begin, and the values in that order."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.append(first, len(keys)), values[order]


def _spread(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ``chosen`` lists its number in ``chosen`` and the place of each of its values."""
    size = first[chosen + 1] - first[chosen]
    which = np.repeat(np.arange(len(chosen)), size)
    return which, np.repeat(first[chosen] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(which))


@dataclass
class OfLength:
    """The distinct passages of one length: where each begins in the items' terms, the items that have it, and for each size
    of piece the pieces' hashes with the passages and offsets they stand for."""

    length: int
    errors: int
    starts: np.ndarray
    item_first: np.ndarray
    items: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(tokens: np.ndarray, starts: np.ndarray, item: np.ndarray, length: int, errors: int) -> OfLength:
        rolled = {}

        def at(size: int, where: np.ndarray) -> np.ndarray:
            if size not in rolled:
                rolled[size] = shingle_hashes(tokens, size)
            return rolled[size][where]

        whole = at(length, starts)
        _, first, number = np.unique(whole, return_index=True, return_inverse=True)
        own = starts[first]
        both = np.unique(np.stack([number, item]), axis=1)  # an item may repeat a passage
        _, item_first, items = _lists(both[0], both[1])
        sizes = [length // (errors + 1) + (i < length % (errors + 1)) for i in range(errors + 1)]
        offsets = np.cumsum([0, *sizes])[:-1]
        passage = np.arange(len(own))
        pieces = {}
        for size in set(sizes):
            of_size = [int(o) for o, s in zip(offsets, sizes) if s == size]
            code = np.concatenate([passage * length + o for o in of_size])
            pieces[size] = _lists(np.concatenate([at(size, own + o) for o in of_size]), code)
        return OfLength(length, errors, own, item_first, items.astype(np.int32), pieces)


class Passages:
    """All passages of one block of items."""

    def __init__(self, items: list[tuple], window: int, errors: int, least: int) -> None:
        cache = TermHashes()
        own = [(key, np.fromiter(map(cache.__getitem__, t), np.uint64, len(t))) for key, text in items if len(t := terms(text)) >= least]
        self.keys = [key for key, _ in own]
        self.tokens = np.concatenate([t for _, t in own]) if own else np.empty(0, np.uint64)
        lengths = np.array([len(t) for _, t in own], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.classes: list[OfLength] = []
        for length in range(least, window + 1):
            chosen = np.flatnonzero(lengths >= window if length == window else lengths == length)
            if len(chosen):
                count = lengths[chosen] - length + 1
                item = np.repeat(chosen, count)
                starts = np.repeat(begins[chosen] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(len(item))
                self.classes.append(OfLength.of(self.tokens, starts, item, length, errors if length == window else 0))

    def found(self, texts: list[list[np.ndarray]] | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and least distance of every leak; ``texts`` are arrays of the terms' hashes."""
        lengths = np.array([len(t) for t in texts], np.int64)
        tokens = np.concatenate(texts) if len(texts) else np.empty(0, np.uint64)
        text = np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(lengths)
        out = []
        for of in self.classes:
            for passage, at, distance in self._met(of, tokens, text, ends - lengths, ends):
                which, place = _spread(of.item_first, passage)
                out.append(np.stack([at[which], of.items[place], distance[which]]))
        each = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
        if not each.shape[1]:  # pieces may be hit without any passage
            return tuple(each)
        each = each[:, np.lexsort(each[::-1])]
        return tuple(each[:, np.append(True, (each[:2, 1:] != each[:2, :-1]).any(axis=0))])

    def _met(self, of: OfLength, tokens: np.ndarray, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Passages, the texts that have them, and how far they are at each place where a piece is hit."""
        places = []
        for size, (hashes, first, codes) in of.pieces.items():
            grams = shingle_hashes(tokens, size)
            near = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            hit = np.flatnonzero((hashes[near] == grams) & (text[: len(grams)] == text[size - 1 :]))
            which, place = _spread(first, near[hit])
            passage, offset = np.divmod(codes[place], of.length)
            begin = hit[which] - offset
            fits = begin >= begins[text[hit[which]]] - of.errors
            places.append(np.stack([text[hit[which]], passage, begin])[:, fits])
        at, passage, begin = np.unique(np.concatenate(places, axis=1), axis=1)
        for i in range(0, len(at), _CANDIDATES):
            part = slice(i, i + _CANDIDATES)
            distance = self._distance(of, tokens, passage[part], begin[part], begins[at[part]], ends[at[part]])
            close = distance <= of.errors
            yield passage[part][close], at[part][close], distance[close]

    def _distance(self, of: OfLength, tokens: np.ndarray, passage: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        spot = begin[:, None] + np.arange(-of.errors, of.length + of.errors)
        around = np.where((spot >= low[:, None]) & (spot < high[:, None]), tokens[np.clip(spot, 0, len(tokens) - 1)], np.uint64(0))  # 0 is no term's hash
        patterns = self.tokens[of.starts[passage][:, None] + np.arange(of.length)]
        distance = np.where((around[:, of.errors : of.errors + of.length] == patterns).all(axis=1), 0, of.errors + 1)
        if of.errors:
            rest = np.flatnonzero(distance)
            many = myers_many if of.length <= 64 else lambda a, b: np.array([myers(x, y) for x, y in zip(a.tolist(), b.tolist())], int)
            distance[rest] = many(patterns[rest], around[rest])
        return distance


def leaks(records: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 12, errors: int = 1, least: int | None = None) -> DataFrame:
    """``<key>, <item_key>, distance``: every record and item of which a passage is in the record within the budget.

    Items of ``least`` to ``window`` - 1 terms are found where a record has all their terms in a run.
    """
    least = window if least is None else least
    if errors < 0 or window <= errors or not 1 <= least <= window:
        raise ValueError("a passage must have more terms than errors, and least must be from 1 to window")
    spark = records.sparkSession
    given = records.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    kind, item_kind = dict(given.dtypes)[key], dict(items.dtypes)[item_key]
    item_type = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for block in _blocks(items.select(item_key, text).where(F.col(text).isNotNull())):
        sent = spark.sparkContext.broadcast(Passages(block, window, errors, least))

        def seek(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            passages, cache = sent.value, TermHashes()
            for b in batches:
                for at in range(0, b.num_rows, _RECORDS):
                    part = b.slice(at, _RECORDS)
                    texts = [np.fromiter(map(cache.__getitem__, own), np.uint64, len(own)) for own in map(terms, part.column(1).to_pylist())]
                    record, item, distance = passages.found(texts)
                    if len(record):
                        of = pa.array([passages.keys[i] for i in item.tolist()], item_type)
                        yield pa.record_batch([part.column(0).take(pa.array(record)), of, pa.array(distance.astype(np.int32))], [key, item_key, "distance"])

        hit = given.mapInArrow(seek, f"`{key}` {kind}, `{item_key}` {item_kind}, distance int")
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else spark.createDataFrame([], f"`{key}` {kind}, `{item_key}` {item_kind}, distance int")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block
