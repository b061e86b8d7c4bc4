"""Cutting texts that are too long into pieces at natural boundaries, with an overlap.

Method: a text's tokens have their offsets (starts and ends) in sorted arrays; the ends of paragraphs, lines, sentences
and words are sorted subsets of the token ends. For each piece the last end of the coarsest unit under the limit is found
by binary search; where there is none of any unit the cut is hard. The next piece steps back by the overlap to the start
of a word, as far as the limit lets it.

Blank characters, lines, paragraphs, sentences and words are as TESTDATA.md states them (p5_found). Offsets count code
points. Blanks at the ends of a piece are left out. A null text, and one of at most ``limit`` characters, gives no row; a
longer text of blanks alone is one row without pieces whose boundary is 'paragraph'. Whole texts are looked at, of any
length, one at a time. Repeated rows are cut as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the definition.
BLANKS = "\t\n\r  　"
ENDS_BEFORE_BLANK = ".!?"
ENDS_ALWAYS = "。！？"
UNITS = ("paragraph", "line", "sentence", "word", "hard")

_BLANK, _STOP, _WIDE_STOP = (np.array([ord(c) for c in s], np.uint32) for s in (BLANKS, ENDS_BEFORE_BLANK, ENDS_ALWAYS))


def _any_of(points: np.ndarray, of: np.ndarray) -> np.ndarray:
    hit = points == of[0]
    for c in of[1:]:
        hit |= points == c
    return hit


class Offsets:
    """Token offsets of a text and, for each unit, which tokens are a unit's last."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        full = np.zeros(len(points) + 2, bool)
        full[1:-1] = ~_any_of(points, _BLANK)
        wide = _any_of(points, _WIDE_STOP)
        begins, ends = full[1:-1] & ~full[:-2], full[1:-1] & ~full[2:]
        inner = wide[:-1] & full[2:-1]  # a sentence ends within a word
        word_end = ends.copy()
        ends[:-1] |= inner
        begins[1:] |= inner
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        last = self.ends - 1
        line = np.cumsum(points == 10)[self.starts] if len(self.starts) else np.empty(0, int)
        step = np.append(np.diff(line), 2) if len(line) else line
        self.word_starts = self.starts[np.append(True, word_end[last[:-1]])] if len(last) else self.starts
        word = word_end[last]
        sentence = wide[last] | (word & _any_of(points[last], _STOP))
        self.last_of = {"paragraph": step > 1, "line": step > 0, "sentence": sentence | (step > 0), "word": word}

    def longest(self, unit: str) -> int:
        if not len(self.ends):
            return 0
        is_last = self.last_of[unit]
        begin = self.starts[np.append(True, is_last[:-1])]
        return int((self.ends[is_last] - begin).max())

    def boundary(self, limit: int) -> str:
        """The coarsest unit of which none is longer than ``limit``."""
        return next((u for u in UNITS[:-1] if self.longest(u) <= limit), "hard")

    def cuts(self, limit: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        """Start, end and kind of end of each piece."""
        if not len(self.ends):
            return
        by_unit = [self.ends[self.last_of[u]] for u in UNITS[:-1]]
        stop, begin, end = int(self.ends[-1]), int(self.starts[0]), 0
        while True:
            first = begin  # of what is new in this piece
            back = self._word_start(end - overlap, end) if end else first
            for unit, at in zip(UNITS, by_unit):
                k = int(np.searchsorted(at, first + limit, side="right"))
                if k and at[k - 1] > max(end, first):
                    cut, kind = int(at[k - 1]), unit
                    # with the whole overlap, if that leaves a cut of this unit
                    j = int(np.searchsorted(at, back + limit, side="right"))
                    if j and at[j - 1] > max(end, first):
                        cut = int(at[j - 1])
                    break
            else:
                if end:
                    back = min(max(end - overlap, 0), first)
                    back = max(back, int(self.starts[np.searchsorted(self.ends, back, side="right")]))
                    back = back if back + limit > first else first  # there must be something new
                cut, kind = min(back + limit, stop), "hard"
            start = first if not end else back if cut - back <= limit else self._word_start(cut - limit, end)
            yield (start if start < end or not end else first), cut, kind
            if cut >= stop:
                return
            end = cut
            k = int(np.searchsorted(self.ends, end, side="right"))
            begin = max(end, int(self.starts[k]))

    def _word_start(self, least: int, end: int) -> int:
        """The first start of a word from ``least`` on that is before ``end``, else ``end``."""
        k = int(np.searchsorted(self.word_starts, least))
        return int(self.word_starts[k]) if k < len(self.word_starts) and self.word_starts[k] < end else end


def _long(records: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Key and text of the texts that are too long."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("there must be a limit, and the overlap must be less")
    return records.select(F.col(key), F.col(text)).where(F.length(text) > limit)


def cut_texts(records: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2000, overlap: int = 100) -> DataFrame:
    """``<key>, boundary, cuts`` of every text longer than ``limit``; one row a text.

    ``cuts`` is an array of ``start, end, kind``. Pieces are at most ``limit`` long, with their overlap.
    """
    given = _long(records, key, text, limit, overlap)
    kind = dict(given.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            boundaries, cuts = [], []
            for t in b.column(1).to_pylist():
                offsets = Offsets(t)
                boundaries.append(offsets.boundary(limit))
                cuts.append([{"start": s, "end": e, "kind": k} for s, e, k in offsets.cuts(limit, overlap)])
            yield pa.record_batch([b.column(0), pa.array(boundaries, pa.string()), pa.array(cuts, piece)], [key, "boundary", "cuts"])

    return given.mapInArrow(cut, f"`{key}` {kind}, boundary string, cuts array<struct<start: int, end: int, kind: string>>")


def pieces(records: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2000, overlap: int = 100) -> DataFrame:
    """``<key>, piece, start, end, kind, text``: one row a piece of every text longer than ``limit``, numbered from 0.

    Pieces are taken from their text where it is cut, so a text is gone through once and never repeated.
    """
    given = _long(records, key, text, limit, overlap)
    kind = dict(given.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                cuts = list(Offsets(t).cuts(limit, overlap))
                if cuts:
                    starts, ends, kinds = zip(*cuts)
                    numbers = (pa.array(x, pa.int32()) for x in (range(len(cuts)), starts, ends))
                    own = b.column(0).slice(i, 1).take(pa.array([0] * len(cuts)))
                    yield pa.record_batch([own, *numbers, pa.array(kinds), pa.array([t[s:e] for s, e in zip(starts, ends)])], [key, "piece", "start", "end", "kind", text])

    return given.mapInArrow(cut, f"`{key}` {kind}, piece int, start int, end int, kind string, `{text}` string")
