"""Corpora in other formats, as ``document_id, text``.

Parquet, CSV, JSON and ORC are Spark's own readers. The service this follows keeps a shard in an SQLite file; ``SqliteCorpus``
is a Python data source for such files, read in parallel by stretches of row numbers and written one file a task.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from findery.schema import CORPUS

#: Rows of an SQLite file that is written.
ROWS_OF_A_FILE = 100_000
FORMATS = ("parquet", "csv", "json", "orc", "text")


def read_corpus(spark: SparkSession, path: str, format: str = "parquet", document_id: str = "document_id", text: str = "text", **options: str) -> DataFrame:
    """``document_id, text`` from files of any of FORMATS, or ``sqlite``. No schema is inferred for CSV and JSON.

    In CSV a text in quotes is itself, also where it is empty; an empty field without quotes is null.
    """
    from pyspark.sql import functions as F

    if format == "sqlite":
        spark.dataSource.register(SqliteCorpus)
        return spark.read.format("sqlite_corpus").option("path", path).options(**options).load()
    if format not in FORMATS:
        raise ValueError(f"format must be sqlite or one of {FORMATS}")
    reader = spark.read.format(format).options(**options)
    if format == "text":  # one document a file
        return reader.option("wholetext", "true").load(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document_id"), F.col("value").alias("text"))
    if format in ("csv", "json"):
        if format == "csv":
            reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
            if "nullvalue" not in map(str.lower, options):  # Spark's own is the empty text, which would make "" a null too
                reader = reader.option("nullValue", uuid.uuid4().hex)
        reader = reader if format == "csv" else reader.schema(f"`{document_id}` string, `{text}` string")
    return reader.load(path).select(F.col(document_id).cast("string").alias("document_id"), F.col(text).alias("text"))


def _located(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs as pafs  # only where files are opened: it starts threads

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _listed(files, folder: str) -> list:
    from pyarrow import fs as pafs

    return files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


def _opened(path: str) -> sqlite3.Connection:
    """A database to read; one that is not on a local disk is read into memory."""
    files, at = _located(path)
    if files.type_name == "local":
        return sqlite3.connect(f"file:{at}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    with files.open_input_file(at) as f:
        db.deserialize(f.read())
    return db


class _Stretch(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerPartition", "100000"))

    def partitions(self) -> list[InputPartition]:
        at, path = _located(self.path)
        if at.get_file_info(path).is_file:
            files = [self.path]
        else:
            names = (i.base_name for i in _listed(at, path))
            files = sorted(f"{self.path.rstrip('/')}/{n}" for n in names if n.endswith((".db", ".sqlite")))
        out: list[InputPartition] = []
        for f in files:
            with closing(_opened(f)) as db:
                low, high = db.execute("SELECT min(rowid), max(rowid) FROM documents").fetchone()
            if low is not None:
                out += [_Stretch(f, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out or [_Stretch("", 0, -1)]

    def read(self, partition: _Stretch) -> Iterator[tuple[str, str]]:
        if not partition.path:
            return
        with closing(_opened(partition.path)) as db:
            yield from db.execute("SELECT document_id, text FROM documents WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, folder = _located(self.path)
        files.create_dir(folder, recursive=True)
        paths = []
        while block := list(islice(rows, ROWS_OF_A_FILE)):
            # made in memory, as the folder need not be on a disk
            with closing(sqlite3.connect(":memory:")) as db:
                db.execute("CREATE TABLE documents (document_id TEXT PRIMARY KEY, text TEXT NOT NULL)")
                db.executemany("INSERT OR REPLACE INTO documents VALUES (?, ?)", ((r[0], r[1]) for r in block))
                db.commit()
                paths.append(f"{folder}/.{uuid.uuid4().hex}.db.part")
                with files.open_output_stream(paths[-1]) as out:
                    out.write(db.serialize())
        return _Written(paths)

    def commit(self, messages: list) -> None:
        files, folder = _located(self.path)
        if self.overwrite:
            for i in _listed(files, folder):
                if i.base_name.endswith(".db"):
                    files.delete_file(i.path)
        for p in (p for m in messages if m is not None for p in m.paths):
            head, _, name = p.rpartition("/")
            files.move(p, f"{head}/{name[1:].removesuffix('.part')}")

    def abort(self, messages: list) -> None:
        files, _ = _located(self.path)
        for p in (p for m in messages if m is not None for p in m.paths):
            if files.get_file_info(p).is_file:
                files.delete_file(p)


class SqliteCorpus(DataSource):
    """``documents(document_id, text)`` of an SQLite file, or of all ``.db`` files of a folder that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_corpus"

    def schema(self) -> StructType:
        return CORPUS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SqliteWriter(self.options, overwrite)
