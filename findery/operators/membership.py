"""Bits that tell of nearly every row whether its id may be among given ids, where these are too many to be sent themselves.

A row that is among them always passes; of the others about one in BITS_AN_ID does, unless the ids are so many that the
MOST_BITS fill up. Whoever filters by it joins afterwards, with the few that pass instead of with whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_AN_ID, MOST_BITS = 16, 1 << 29


def parted(rows: DataFrame, ids: DataFrame, count: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose ``key`` is among the ``count`` ids of ``ids``, with some others, and the rest; no row is shuffled."""
    bits = min(MOST_BITS, 1 << max(15, (BITS_AN_ID * count - 1).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits)) + 1  # Spark's bitmaps count from 1
    placed = ids.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).repartition("part")
    whole = np.zeros(bits // 8, np.uint8)
    for part, held in placed.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        whole[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(whole)

    def part(wanted: int) -> DataFrame:
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                place = b.column(0).to_numpy()
                own = np.flatnonzero((sent.value[place >> 3] >> (place & 7) & 1) == wanted)
                yield pa.RecordBatch.from_arrays(b.columns[1:], b.schema.names[1:]).take(pa.array(own))

        return rows.select((at - 1).alias("place"), *rows.columns).mapInArrow(chosen, rows.schema)

    return part(1), part(0)


def those_among(rows: DataFrame, ids: DataFrame, count: int, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among the ``count`` ids of ``ids``, and some others."""
    return parted(rows, ids, count, key)[0]


def those_not_among(rows: DataFrame, ids: DataFrame, count: int, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is not among them; of these only those are shuffled that the bits do not tell of."""
    maybe, others = parted(rows, ids, count, key)
    return others.unionByName(maybe.join(ids, key, "left_anti"))
