"""The stored corpus: immutable snapshots, layers of changes, and a pointer.

A store is a folder with ``snapshot-<generation>-<id>`` and ``delta-<generation>-<id>`` folders of Parquet, and a small
manifest that names the current snapshot and the deltas on it with its generation and state. A change writes a delta of the
documents it touches and then replaces the manifest by an atomic rename, so what is written follows the change and not the
corpus, a failed change leaves the former corpus, and a reader that has opened it keeps a consistent one. Readers merge the
deltas (``layers``); now and then these are merged or become a new snapshot, which is sorted by id so that a lookup reads
few row groups. What ``put`` and ``delete`` return reads the files before the change, which stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.errors import InvalidDocument, NotReady, StorageError
from findery.schema import CORPUS
from findery.sources.layers import merged, mergeable, newest, outgrown

STATES = ("starting", "recovering", "ready", "degraded", "out_of_sync")


def blank(document_id: Column) -> Column:
    """Whether an id is null or of white space only, by the Unicode definition."""
    return F.coalesce(document_id.rlike(r"(?U)^[\s\x1c-\x1f]*$"), F.lit(True))


def valid_documents(df: DataFrame) -> DataFrame:
    """``document_id, text`` of rows with an id that is not blank and a text that is not null."""
    return df.where(~blank(F.col("document_id")) & F.col("text").isNotNull()).select("document_id", "text")


def require_valid(df: DataFrame) -> None:
    """Raise for the first row with a blank id or a null text."""
    bad = df.where(blank(F.col("document_id")) | F.col("text").isNull()).select("document_id").limit(1).collect()
    if bad:
        raise InvalidDocument(f"a document has a blank id or no text: {bad[0][0]!r}")


@dataclass(frozen=True)
class Manifest:
    snapshot: str | None
    generation: int
    state: str = "ready"
    detail: str = "ready"
    rows: int = 0
    #: Names and numbers of rows, oldest first.
    deltas: list[tuple[str, int]] = field(default_factory=list)

    @property
    def names(self) -> set[str]:
        return {self.snapshot, *(name for name, _ in self.deltas)}


class DocumentStore(Protocol):
    """What the engine needs of a store."""

    def scan(self) -> DataFrame: ...
    def get(self, document_id: str) -> str | None: ...
    def count(self) -> int: ...
    def put(self, documents: DataFrame, generation: int) -> DataFrame: ...
    def delete(self, ids: DataFrame, generation: int) -> DataFrame: ...
    def change(self, ids: DataFrame, left: DataFrame, generation: int) -> None: ...
    def replace_all(self, documents: DataFrame, generation: int) -> None: ...
    @property
    def generation(self) -> int: ...


class MemoryStore:
    """A store that is a plan; for tests and small corpora."""

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None) -> None:
        self.spark = spark
        self._documents = documents.select("document_id", "text") if documents is not None else spark.createDataFrame([], CORPUS)
        self._generation = 0

    @property
    def generation(self) -> int:
        return self._generation

    def scan(self) -> DataFrame:
        return self._documents

    def get(self, document_id: str) -> str | None:
        row = self.scan().where(F.col("document_id") == document_id).select("text").first()
        return row[0] if row else None

    def count(self) -> int:
        return self.scan().count()

    def put(self, documents: DataFrame, generation: int) -> DataFrame:
        """Insert or replace; ``document_id, created`` for each. Of several rows with one id the largest text is kept."""
        require_valid(documents)
        new = documents.groupBy("document_id").agg(F.max("text").alias("text"))
        old = self.scan()
        result = new.select("document_id").join(old.select("document_id", F.lit(False).alias("created")), "document_id", "left").select("document_id", F.coalesce("created", F.lit(True)).alias("created"))
        self._apply(new, generation)
        return result

    def delete(self, ids: DataFrame, generation: int) -> DataFrame:
        """Remove by id; ``document_id, deleted`` for each id asked for."""
        old = self.scan()
        asked = ids.select("document_id").distinct()
        result = asked.join(old.select("document_id", F.lit(True).alias("deleted")), "document_id", "left").select("document_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        self._apply(asked.withColumn("text", F.lit(None).cast("string")), generation)
        return result

    def change(self, ids: DataFrame, left: DataFrame, generation: int) -> None:
        """Replace all that ``ids`` had by ``left``, in one step."""
        require_valid(left)
        self._apply(ids.select("document_id").distinct().join(left.select("document_id", "text"), "document_id", "full_outer"), generation)

    def _apply(self, changes: DataFrame, generation: int) -> None:
        """``changes`` has a row an id, with a null text where the document goes."""
        self._set(merged(self.scan(), [changes], 1 << 62, "text"), generation)

    def replace_all(self, documents: DataFrame, generation: int) -> None:
        require_valid(documents)
        self._set(documents.select("document_id", "text"), generation)

    def _set(self, documents: DataFrame, generation: int) -> None:
        if generation < self._generation:
            raise StorageError(f"generation {generation} is before {self._generation}")
        self._documents, self._generation = documents, generation


class SnapshotStore(MemoryStore):
    """A store in a folder of any file system that Hadoop knows; opened or created by its constructor."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        if not self._fs.exists(self._path(self._manifest_path)):
            self._write(Manifest(None, 0))

    @property
    def _manifest_path(self) -> str:
        return f"{self.folder}/manifest.json"

    def manifest(self) -> Manifest:
        text = "\n".join(r[0] for r in self.spark.read.text(self._manifest_path).collect())
        return Manifest(**json.loads(text))

    def _write(self, manifest: Manifest) -> None:
        draft = f"{self.folder}/.manifest-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        # FileContext renames over an existing file in one step
        jvm = self.spark._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        uri = self._fs.makeQualified(self._path(self.folder)).toUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(self._path(draft), self._path(self._manifest_path), overwrite)

    def mark(self, state: str, detail: str = "") -> None:
        if state not in STATES:
            raise ValueError(f"state must be one of {STATES}")
        self._write(replace(self.manifest(), state=state, detail=detail or state))

    def require_ready(self) -> Manifest:
        m = self.manifest()
        if m.state != "ready":
            raise NotReady(f"{m.state}: {m.detail}")
        return m

    @property
    def generation(self) -> int:
        return self.manifest().generation

    def scan(self) -> DataFrame:
        """The current corpus; in no order."""
        return self._read(self.manifest())

    def _table(self, name: str | None) -> DataFrame:
        return self.spark.read.schema(CORPUS).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], CORPUS)

    def _read(self, m: Manifest) -> DataFrame:
        return merged(self._table(m.snapshot), [self._table(name) for name, _ in m.deltas], sum(n for _, n in m.deltas), "text")

    def export(self) -> tuple[DataFrame, int]:
        """Documents ordered by id, and the generation, of one snapshot."""
        m = self.require_ready()
        return self._read(m).orderBy("document_id"), m.generation

    def _set(self, documents: DataFrame, generation: int) -> None:
        m = self._before(generation)
        name, rows = self._stored("snapshot", documents.repartitionByRange("document_id").sortWithinPartitions("document_id"), generation)
        self._write(replace(m, snapshot=name, rows=rows, deltas=[], generation=generation))

    def _before(self, generation: int) -> Manifest:
        m = self.manifest()
        if generation < m.generation:
            raise StorageError(f"generation {generation} is before {m.generation}")
        return m

    def _stored(self, kind: str, documents: DataFrame, generation: int) -> tuple[str, int]:
        """Name and number of rows of a new folder."""
        name = f"{kind}-{generation}-{uuid.uuid4().hex}"
        documents.select("document_id", "text").write.parquet(f"{self.folder}/{name}")
        return name, self._table(name).count()  # from the footers

    def _apply(self, changes: DataFrame, generation: int) -> None:
        m = self._before(generation)
        m = replace(m, deltas=[*m.deltas, self._stored("delta", changes, generation)], generation=generation)
        self._write(m)
        sizes = [n for _, n in m.deltas]
        if outgrown(m.rows, sizes):
            self._set(self._read(m), generation)
        elif (at := mergeable(sizes)) < len(sizes):
            one = self._stored("delta", newest([self._table(name) for name, _ in m.deltas[at:]]), generation)
            self._write(replace(m, deltas=[*m.deltas[:at], one]))

    def vacuum(self) -> int:
        """Delete snapshots and deltas that the manifest doesn't name; returns how many."""
        current, gone = self.manifest().names, 0
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith(("snapshot-", "delta-")) and name not in current:
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone
