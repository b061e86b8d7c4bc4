"""Positions and running totals in sorted groups of any size.

A window does this in one task for each group, which is right while a group is small. A group of more than ``hot_rows``
rows is instead sorted by range over many tasks together with the other hot groups; each task numbers its own stretch, and
the counts and sums of the stretches before it are added. The stretches' totals are a table of tasks × hot groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.sources.scratch import materialize

HOT_ROWS = 200_000
#: Tasks over which all hot groups together are sorted, and rows of their totals that go to every task.
MOST_STRETCHES, BROADCAST_ROWS = 10_000, 500_000


def running_totals(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Callable[[Column], Column]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``position`` (from 1), ``in_group``, and for each of ``values``, a function of the position, its sum so
    far under its name and the group's sum as ``<name>_all``.

    ``order`` must tell all rows of a group apart; null keys are a group like any other.
    """

    def cold(rows: DataFrame) -> DataFrame:
        sorted_, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
        upto = sorted_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = rows.withColumn("position", F.row_number().over(sorted_).cast("bigint"))
        out = out.withColumns({name: F.sum(value(F.col("position"))).over(upto) for name, value in values.items()})
        return out.withColumns({"in_group": F.count("*").over(whole), **{f"{name}_all": F.sum(value(F.col("position"))).over(whole) for name, value in values.items()}})

    large = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    large = materialize(large, "hot-groups")
    rows_in_hot = large.agg(F.sum("n")).first()[0]
    if not rows_in_hot:
        return cold(df)
    stretches = max(2, rows_in_hot // hot_rows * 2)
    few = large.count() + min(stretches, MOST_STRETCHES) <= BROADCAST_ROWS  # no more than these are parts of a group
    marked = _beside(df, large.select(*by, F.lit(True).alias("hot")), by, few, "left")
    ranged = marked.where("hot").drop("hot").repartitionByRange(int(min(stretches, MOST_STRETCHES)), *by, *order).withColumn("stretch", F.spark_partition_id())
    ranged = materialize(ranged, "hot-rows")  # fixes which row is in which stretch
    inside = Window.partitionBy(*by, "stretch")
    before = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, "stretch").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("in_group", F.sum("n").over(Window.partitionBy(*by))).drop("n")
    numbered = _beside(ranged, counts, [*by, "stretch"], few).withColumn("position", F.row_number().over(inside.orderBy(*order)) + F.col("ahead"))
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumns({f"_own_{name}": F.sum(value(F.col("position"))).over(upto) for name, value in values.items()})
    hot = numbered
    if values:
        sums = numbered.groupBy(*by, "stretch").agg(*(F.max_by(f"_own_{name}", "position").alias(f"_s_{name}") for name in values))
        ahead = {f"_ahead_{name}": F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0.0)) for name in values}
        sums = sums.withColumns(ahead).withColumns({f"{name}_all": F.sum(f"_s_{name}").over(Window.partitionBy(*by)) for name in values}).drop(*(f"_s_{name}" for name in values))
        hot = _beside(numbered, sums, [*by, "stretch"], few).withColumns({name: F.col(f"_own_{name}") + F.col(f"_ahead_{name}") for name in values})
    done = cold(marked.where(F.col("hot").isNull()).drop("hot"))
    return done.unionByName(hot.select(done.columns))


def _beside(rows: DataFrame, totals: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows with the totals of their stretch or hot group, which go to every task if they are few."""
    t = totals.select(*(F.col(c).alias(f"_{c}") for c in keys), *(c for c in totals.columns if c not in keys))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return rows.join(F.broadcast(t) if few else t, match, how).drop(*(f"_{c}" for c in keys))


def running_max_before(df: DataFrame, by: list[str], order: list[Column], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``before``: the largest ``value`` of the rows ahead in its group, null for the first."""
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    large = materialize(df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows), "hot-groups")
    rows_in_hot = large.agg(F.sum("n")).first()[0]
    if not rows_in_hot:
        return df.withColumn("before", F.max(value).over(ahead))
    stretches = max(2, rows_in_hot // hot_rows * 2)
    few = large.count() + min(stretches, MOST_STRETCHES) <= BROADCAST_ROWS
    marked = _beside(df, large.select(*by, F.lit(True).alias("hot")), by, few, "left")
    ranged = marked.where("hot").drop("hot").repartitionByRange(int(min(stretches, MOST_STRETCHES)), *by, *order).withColumn("stretch", F.spark_partition_id())
    ranged = materialize(ranged, "hot-rows")
    earlier = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    highest = ranged.groupBy(*by, "stretch").agg(F.max(value).alias("m")).withColumn("m_ahead", F.max("m").over(earlier)).drop("m")
    inside = Window.partitionBy(*by, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hot = _beside(ranged, highest, [*by, "stretch"], few).withColumn("before", F.greatest(F.max(value).over(inside), F.col("m_ahead")))
    cold = marked.where(F.col("hot").isNull()).drop("hot").withColumn("before", F.max(value).over(ahead))
    return cold.unionByName(hot.select(cold.columns))
