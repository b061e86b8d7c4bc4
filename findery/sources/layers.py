"""Tables that change by small layers: a base, and on it the rows that were written since, newest last.

A layer has one row for each ``document_id`` that a change touched; a row whose live column is null says that the document
is gone. What a table holds is the newest row of each id in the layers, and those rows of the base that no layer has.
A change writes its own rows alone. Layers are merged when there are too many, newest first and only into ones of a like
size, so that a row is rewritten as often as the logarithm of their number; a base is rewritten when the layers have grown
to a share of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layers that are read together without being merged.
MOST_LAYERS = 12
#: Share of the base's rows at which base and layers become a new base, and the least number of rows for that.
SHARE, LEAST_ROWS = 0.2, 1000
#: Ids of layers up to this number are sent to every task, more are joined by shuffle.
BROADCAST_IDS = 500_000


def newest(layers: list[DataFrame]) -> DataFrame:
    """The last row of each id."""
    if len(layers) == 1:
        return layers[0]
    rest = [c for c in layers[0].columns if c != "document_id"]
    marked = reduce(DataFrame.unionByName, (df.withColumn("_layer", F.lit(at)) for at, df in enumerate(layers)))
    # an id is in a layer once, so the layer alone decides
    last = marked.groupBy("document_id").agg(F.max_by(F.struct(*rest), "_layer").alias("_row"))
    return last.select("document_id", *(F.col(f"_row.{c}").alias(c) for c in rest))


def untouched(base: DataFrame, layers: list[DataFrame], rows: int) -> DataFrame:
    """Rows of the base that no layer replaces; the layers have ``rows`` rows."""
    if not layers:
        return base
    ids = reduce(DataFrame.unionByName, (df.select("document_id") for df in layers))
    return base.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, "document_id", "left_anti").select(base.columns)


def merged(base: DataFrame, layers: list[DataFrame], rows: int, live: str) -> DataFrame:
    """What the table holds."""
    if not layers:
        return base
    return untouched(base, layers, rows).unionByName(newest(layers).where(F.col(live).isNotNull()).select(base.columns))


def mergeable(sizes: list[int]) -> int:
    """From which layer on layers are to become one; their number if none are."""
    if len(sizes) <= MOST_LAYERS:
        return len(sizes)
    at, total = len(sizes) - 1, sizes[-1]
    while at and sizes[at - 1] <= 2 * total:
        at -= 1
        total += sizes[at]
    return at if at < len(sizes) - 1 else len(sizes)


def outgrown(base_rows: int, sizes: list[int]) -> bool:
    """Whether base and layers are to become a new base."""
    return sum(sizes) > max(LEAST_ROWS, SHARE * base_rows)
