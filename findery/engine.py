"""One object for a searchable corpus: writes, the three searches, figures, status.

Searches return DataFrames. An engine holds an immutable view of its store's snapshot and of what is derived from it;
``refresh`` builds that anew after the store has changed, writes go through the engine's own methods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.config import DEFAULT_LIMIT, BM25Params, RankFusion, checked_limit
from findery.errors import DocumentNotFound, InvalidDocument, NotReady, SemanticDisabled
from findery.functions.analysis import terms
from findery.functions.embedding import Embedder, Identity
from findery.functions.hashing import shard_col
from findery.operators import bm25, knn
from findery.operators.fusion import reciprocal_rank_fusion
from findery.operators.index import corpus_stats, index_stats
from findery.operators.invariants import engine_violations, index_violations, vector_violations
from findery.operators.sharding import cluster_health, cluster_stats, shard_health, shard_stats
from findery.operators.stored_index import StoredIndex
from findery.sources.corpus import DocumentStore
from findery.sources.layers import merged, mergeable, newest, outgrown
from findery.sources.scratch import materialize

#: Written ids up to this number are sent to every task.
_FEW = 100_000
_HITS = "document_id string, score double, text string, rank int"
_HYBRID = "document_id string, score double, lexical_rank int, semantic_rank int, lexical_score double, semantic_score double, total bigint, rank int, text string"


class SearchEngine:
    def __init__(self, spark: SparkSession, store: DocumentStore, embedder: Embedder | None = None, bm25_params: BM25Params = BM25Params(), fusion: RankFusion = RankFusion(), shards: int = 1) -> None:
        self.spark, self.store, self.embedder = spark, store, embedder
        self.bm25_params, self.fusion, self.shards = bm25_params, fusion, shards
        self.state, self.detail = "starting", "not built yet"
        self.refresh()

    # derived state

    def refresh(self) -> None:
        """Build postings, lengths and vectors from the store, and serve only when that has worked."""
        self.state, self.detail = "recovering", "building derived state"
        try:
            self.documents = self.store.scan()
            self.stored = StoredIndex.build(self.documents)
            self._embed_all()
            self.generation = self.store.generation
        except Exception as error:
            self.state, self.detail = "degraded", f"derived state could not be built: {error}"
            raise
        self.state, self.detail = "ready", "ready"

    def _ready(self) -> None:
        if self.state != "ready":
            raise NotReady(f"{self.state}: {self.detail}")

    @property
    def index(self):
        """The whole inverted index."""
        return self.stored.index

    @property
    def vectors(self) -> DataFrame | None:
        """``document_id, vector`` of all documents, or None without an embedder."""
        if self.embedder is None:
            return None
        return merged(self._vectors, [df for df, _ in self._vector_layers], sum(n for _, n in self._vector_layers), "vector")

    def _embed_all(self) -> None:
        self._vector_layers: list[tuple[DataFrame, int]] = []
        self._vectors = materialize(self.embedder.embed(self.documents), "vectors") if self.embedder else None

    def _embed(self, ids: DataFrame, left: DataFrame) -> None:
        """A layer of the vectors of written documents."""
        layer = materialize(ids.join(self.embedder.embed(left), "document_id", "left").select(self._vectors.columns), "vector-layer")
        layers = [*self._vector_layers, (layer, layer.count())]
        sizes = [n for _, n in layers]
        if outgrown(self.stored.documents, sizes):
            self._vector_layers, self._vectors = [], materialize(merged(self._vectors, [df for df, _ in layers], sum(sizes), "vector"), "vectors")
        elif (at := mergeable(sizes)) < len(sizes):
            one = materialize(newest([df for df, _ in layers[at:]]), "vector-layer")
            self._vector_layers = [*layers[:at], (one, one.count())]
        else:
            self._vector_layers = layers

    def _derive(self, ids: DataFrame) -> None:
        """Change what is derived of the written documents ``ids``, and nothing else."""
        try:
            self.documents = self.store.scan()
            ids = ids.select("document_id").distinct()
            left = materialize(self.documents.join(F.broadcast(ids) if ids.count() <= _FEW else ids, "document_id", "left_semi").select("document_id", "text"), "written")
            self.stored = self.stored.changed(ids, left)
            if self.embedder:
                self._embed(ids, left)
            self.generation = self.store.generation
        except Exception as error:
            self.state, self.detail = "degraded", f"stored, but derived state could not be changed: {error}"
            raise

    # writes

    def upsert(self, documents: DataFrame) -> DataFrame:
        """Insert or replace; ``document_id, created, shard_id``. One batch is one generation. Blank ids are refused."""
        self._ready()
        outcome = materialize(self.store.put(documents, self.store.generation + 1), "outcome")
        self._derive(outcome.select("document_id"))
        return outcome.withColumn("shard_id", shard_col("document_id", self.shards))

    def delete(self, document_ids: DataFrame | Sequence[str]) -> DataFrame:
        """Delete the ids of a table (or a few given ones); ``document_id, deleted``. A batch in which nothing is found uses no
        generation."""
        self._ready()
        if isinstance(document_ids, DataFrame):
            ids = document_ids.select("document_id").distinct()
        else:
            ids = self.spark.createDataFrame([(i,) for i in sorted(set(document_ids))], "document_id string")
        found = ids.join(self.documents, "document_id", "left_semi")
        if found.isEmpty():
            return ids.withColumn("deleted", F.lit(False))
        outcome = materialize(self.store.delete(ids, self.store.generation + 1), "outcome")
        self._derive(ids)
        return outcome

    def get(self, document_id: str) -> str:
        text = self.store.get(document_id)
        if text is None:
            raise DocumentNotFound(document_id)
        return text

    # searches

    def search(self, query: str, limit: int = DEFAULT_LIMIT) -> tuple[DataFrame, int]:
        """Hits ``document_id, score, text, rank``, and how many documents match."""
        checked_limit(limit)
        self._ready()
        words = terms(query)
        if not words:
            return self.spark.createDataFrame([], _HITS), 0
        scored = self._lexical(words)
        hits = bm25.with_text(bm25.best(scored, limit).drop("query_id"), self.documents)
        return hits.select("document_id", "score", "text", "rank").orderBy("rank"), scored.count()

    def _lexical(self, words: list[str]) -> DataFrame:
        index = self.stored.lookup(words)
        return materialize(bm25.score(index, bm25.query_terms(self.spark, {0: words}), self.bm25_params, self.stored.stats(index.postings)), "scored")

    def _query_vector(self, query: str | Sequence[float], identity: Identity | None) -> list[float]:
        if self.embedder is None:
            raise SemanticDisabled("this engine has no embedder")
        if identity is not None:
            self.embedder.identity.require(identity)
        if not isinstance(query, str):
            return knn.checked_query(query, self.embedder.identity.dimension)
        one = self.spark.createDataFrame([("q", query)], "document_id string, text string")
        return [float(x) for x in self.embedder.embed(one).first()["vector"]]

    def semantic_search(self, query: str | Sequence[float], limit: int = DEFAULT_LIMIT, identity: Identity | None = None) -> tuple[DataFrame, int]:
        """Hits by cosine, and how many vectors were searched. Also an empty query is embedded as it is."""
        checked_limit(limit)
        self._ready()
        vector = self._query_vector(query, identity)
        hits = knn.vector_topk(self.vectors, vector, limit, self.embedder.identity.dimension)
        ranked = bm25.best(hits.withColumn("query_id", F.lit(0)), limit).drop("query_id")
        return bm25.with_text(ranked, self.documents).select("document_id", "score", "text", "rank").orderBy("rank"), self.vectors.count()

    def hybrid_search(self, query: str, limit: int = DEFAULT_LIMIT, explain: bool = False, identity: Identity | None = None) -> tuple[DataFrame, int]:
        """Hits of both searches fused, and the number of candidates. A query without terms is empty before anything else."""
        checked_limit(limit)
        words = terms(query)
        if not words:
            return self.spark.createDataFrame([], _HYBRID), 0
        self._ready()
        depth = self.fusion.depth(limit)
        vector = self._query_vector(query, identity)
        lexical = bm25.best(self._lexical(words), depth)
        near = knn.vector_topk(self.vectors, vector, depth, self.embedder.identity.dimension).withColumn("query_id", F.lit(0).cast("bigint"))
        fused = materialize(reciprocal_rank_fusion(lexical, bm25.best(near, depth), limit, self.fusion, explain), "fused")
        first = fused.select("total").first()
        return bm25.with_text(fused.drop("query_id"), self.documents).orderBy("rank"), first[0] if first else 0

    # figures

    def stats(self) -> DataFrame:
        self._ready()
        return index_stats(self.index)

    def corpus_stats(self, words: Sequence[str]) -> DataFrame:
        self._ready()
        return corpus_stats(self.stored.lookup(words), words)

    def shard_stats(self) -> DataFrame:
        self._ready()
        by = shard_col("document_id", self.shards)
        return shard_stats(self.index.lengths.withColumn("shard_id", by), self.index.postings.withColumn("shard_id", by))

    def cluster_stats(self) -> DataFrame:
        return cluster_stats(self.shard_stats())

    def status(self) -> dict[str, object]:
        return {"state": self.state, "ready": self.state == "ready", "detail": self.detail, "generation": getattr(self, "generation", 0), "semantic": self.embedder is not None}

    def cluster_status(self, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What each shard's copies (``shard_id, copy_no, copy_role, node_state, endpoint``) can do, with its figures here, and
        what all together can do."""
        shards = shard_health(copies).join(self.shard_stats(), "shard_id", "left")
        figures = self.cluster_stats().drop("shards")
        return shards, cluster_health(copies).crossJoin(F.broadcast(figures))

    def vector_ids(self) -> DataFrame:
        """``document_id`` of every vector."""
        self._ready()
        if self.embedder is None:
            raise SemanticDisabled("this engine has no embedder")
        return self.vectors.select("document_id")

    def export(self) -> tuple[DataFrame, int]:
        """The corpus ordered by id, and its generation."""
        self._ready()
        return self.documents.orderBy("document_id"), self.generation

    def violations(self) -> DataFrame:
        """All integrity checks; empty if all is well."""
        out = index_violations(self.index).unionByName(engine_violations(self.documents, self.index, self.vectors, (self.store.generation, self.generation)))
        return out.unionByName(vector_violations(self.vectors, self.embedder.identity.dimension)) if self.embedder else out

    def resynchronize(self, documents: DataFrame, generation: int) -> None:
        """Replace the corpus by another copy's export, and build what is derived."""
        self.state, self.detail = "recovering", f"resynchronizing to generation {generation}"
        try:
            self.store.replace_all(documents, generation)
        except InvalidDocument:
            self.state, self.detail = "out_of_sync", "the export could not be stored"
            raise
        self.refresh()
