"""Which shard owns a document."""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shard_for(document_id: str, shards: int) -> int:
    """The first 8 bytes of BLAKE2b over the id's UTF-8, as a big-endian number, modulo the number of shards."""
    if shards < 1:
        raise ValueError("there must be a shard")
    return int.from_bytes(blake2b(document_id.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % shards


@F.pandas_udf(T.IntegerType())
def _shard(ids: pd.Series, shards: pd.Series) -> pd.Series:
    return pd.Series([None if i is None else shard_for(i, int(n)) for i, n in zip(ids, shards)], dtype="Int32")


def shard_col(document_id: Column | str, shards: int) -> Column:
    """Owning shard of each id; null for a null id. Spark has no BLAKE2b, hence an Arrow UDF, and only for this column:
    plans are partitioned by Spark's own hash."""
    if shards < 1:
        raise ValueError("there must be a shard")
    return _shard(F.col(document_id) if isinstance(document_id, str) else document_id, F.lit(shards))


def register_hashing(spark: SparkSession) -> None:
    spark.udf.register("shard_for", _shard)
