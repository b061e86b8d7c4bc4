"""Intermediate tables in the folder that all executors share.

A plan that is used twice, or that has grown long, is written once as Parquet and read back, which also cuts its lineage:
the files outlive any executor. The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (tests on
one machine) a temporary folder of the driver is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffled files of an execution as it ends, and not when the driver happens to collect garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; set to a local one where the session names none."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.conf.set(_SETTING, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that ``release`` deletes, with whatever is written there."""
    path = f"{shared_folder(spark)}/findery/{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and return the written table; what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = temporary(spark, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that no plan reads any more."""
    spark, path = table.sparkSession, _paths.pop(table)
    _delete(spark, path)
    _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete every ``temporary`` path and table. Call it only when no plan that reads them will run again."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is then cleaned with the cluster's
            return


atexit.register(release)
