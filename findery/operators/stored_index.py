"""An inverted index in files that changes by layers.

The base has its postings in buckets by term, so a query reads those of its terms alone. A change writes one row for each
document it touches, with the document's length and its terms' counts (a null length where it is gone); of the base's
postings those of touched documents are left out when they are read. Layers are merged, and become a new base, as
``sources.layers`` has it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators.index import BUCKETS, InvertedIndex, Matches, counted, counted_index, document_frequency, totals
from findery.sources.layers import merged, mergeable, newest, outgrown, untouched
from findery.sources.scratch import materialize, temporary

#: Documents to a bucket of terms, as long as there are no more than BUCKETS.
DOCUMENTS_PER_BUCKET = 2000


@dataclass(frozen=True)
class StoredIndex:
    base: InvertedIndex
    documents: int
    layers: tuple[tuple[DataFrame, int], ...] = ()

    @staticmethod
    def build(documents: DataFrame) -> StoredIndex:
        """The index of all documents, written below the session's shared folder."""
        return StoredIndex._of(counted_index(documents), documents.sparkSession)

    @staticmethod
    def _of(index: InvertedIndex, spark: SparkSession) -> StoredIndex:
        rows = index.lengths.count()
        path, buckets = temporary(spark, f"index-{uuid.uuid4().hex}"), max(1, min(BUCKETS, rows // DOCUMENTS_PER_BUCKET))
        index.save(path, buckets)
        return StoredIndex(InvertedIndex.load(spark, path, buckets), rows)

    def changed(self, ids: DataFrame, left: DataFrame) -> StoredIndex:
        """The index after ``ids`` were written; ``left`` has their documents (``document_id, text``) that are left."""
        fresh = counted(left.join(ids.select("document_id"), "document_id", "left_semi"))
        layer = materialize(ids.select("document_id").distinct().join(fresh, "document_id", "left"), "index-layer")
        new = replace(self, layers=(*self.layers, (layer, layer.count())))
        sizes = [n for _, n in new.layers]
        if outgrown(self.documents, sizes):
            return StoredIndex._of(new.index, layer.sparkSession)
        if (at := mergeable(sizes)) < len(sizes):
            one = materialize(newest([df for df, _ in new.layers[at:]]), "index-layer")
            return replace(new, layers=(*new.layers[:at], (one, one.count())))
        return new

    @cached_property
    def _newest(self) -> DataFrame | None:
        return newest([df for df, _ in self.layers]) if self.layers else None

    def _with_layers(self, postings: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
        """``postings`` of the base as the layers leave them, and the layers' own."""
        if not self.layers:
            return postings
        kept = untouched(postings, [df for df, _ in self.layers], sum(n for _, n in self.layers))
        own = Matches(self._newest.where(F.col("dl").isNotNull())).index().postings
        return kept.unionByName(own if words is None else own.where(F.col("term").isin(*words)) if words else own.where(F.lit(False)))

    @property
    def lengths(self) -> DataFrame:
        layers = [df.select("document_id", "dl") for df, _ in self.layers]
        return merged(self.base.lengths, layers, sum(n for _, n in self.layers), "dl")

    @property
    def index(self) -> InvertedIndex:
        """The whole index."""
        return InvertedIndex(self._with_layers(self.base.postings.drop("bucket")), self.lengths)

    def lookup(self, words: Sequence[str]) -> InvertedIndex:
        """The index of some terms; of the base only their buckets are read."""
        chosen = sorted(set(words))
        return InvertedIndex(self._with_layers(self.base.lookup(chosen), chosen), self.lengths)

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Documents and terms."""
        return tuple(totals(self.lengths).first())

    def stats(self, postings: DataFrame) -> DataFrame:
        """``term, df, n, total_len`` of the terms of ``postings``."""
        n, total_len = self.totals
        return document_frequency(postings).withColumns({"n": F.lit(n).cast("bigint"), "total_len": F.lit(total_len).cast("bigint")})
