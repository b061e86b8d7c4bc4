"""The mutation log as a stream: sequencing with state, and applying to a store.

``classify_stream`` classifies every micro-batch with the batch operator, from the state that the one before left; a shard
that holds most of a micro-batch is spread over tasks, and a repeated micro-batch replaces what it wrote. ``sequenced`` does
the same as a stateful operator, on what decides alone (no texts), whose shards must fit a worker. ``apply_stream`` applies
micro-batches to stores: it is idempotent, as a repeated micro-batch is all duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findery.operators.mutations import APPLIED, BROADCAST_SHARDS, DUPLICATE, GAP, REFUSED, classify, compact, readable, touched
from findery.operators.running import running_max_before
from findery.sources.corpus import MemoryStore

#: Shards that are applied at the same time.
AT_ONCE = 8
_OUT = "shard_id int, generation bigint, op string, document_id string, outcome string"
_STATE = "local bigint, stopped boolean"


def outcomes(local: int, stopped: bool, generations: list[int]) -> tuple[list[str], int, bool]:
    """Outcome of each generation met in turn, and the state after them."""
    out = []
    for g in generations:
        if g <= local:
            out.append(DUPLICATE)
        elif g > local + 1:
            out.append(GAP)
            stopped = True
        elif stopped:
            out.append(REFUSED)
        else:
            out.append(APPLIED)
            local = g
    return out, local, stopped


def sequenced(log: DataFrame) -> DataFrame:
    """``shard_id, generation, op, document_id, outcome`` of a streaming log. Rows of a shard in one micro-batch are taken in
    order of generation.

    Rows without a shard or generation are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        local, stopped = state.get if state.exists else (0, False)
        # the order within a micro-batch is by generation, so a micro-batch of a shard is read as a whole
        rows = pd.concat(list(frames), ignore_index=True).sort_values("generation", kind="stable")
        rows["outcome"], local, stopped = outcomes(int(local), bool(stopped), rows["generation"].tolist())
        state.update((local, stopped))
        yield rows[["shard_id", "generation", "op", "document_id", "outcome"]]

    given = log.where(F.col("shard_id").isNotNull() & F.col("generation").isNotNull()).select("shard_id", "generation", "op", "document_id")
    return given.groupBy("shard_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def classify_stream(log: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start classifying a streaming log. ``<folder>/outcomes`` gets its rows with ``outcome`` by ``batch``, and
    ``<folder>/state`` each shard's generation after the batch and whether it has stopped.

    Rows of a micro-batch are taken in order of generation; rows without a shard or generation are left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"shard_id {dict(batch.dtypes)['shard_id']}, {_STATE}"
        before = spark.read.schema(schema).parquet(f"{folder}/state/batch={number - 1}") if number else spark.createDataFrame([], schema)
        side = F.broadcast(before) if before.count() <= BROADCAST_SHARDS else before
        met = batch.where(F.col("shard_id").isNotNull() & F.col("generation").isNotNull()).join(side, "shard_id", "left")
        known = classify(met, [F.col(c) for c in ("generation", "op", "document_id", "text")], F.coalesce("local", F.lit(0)), F.coalesce("stopped", F.lit(False)))
        path = f"{folder}/outcomes/batch={number}"
        known.drop("local", "stopped").write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path).groupBy("shard_id").agg(F.max(F.when(F.col("outcome") == APPLIED, F.col("generation"))).alias("last"), F.bool_or(F.col("outcome") == GAP).alias("gap"))
        both = before.join(after, "shard_id", "full_outer")
        state = both.select("shard_id", F.greatest("local", "last", F.lit(0)).alias("local"), (F.coalesce("stopped", F.lit(False)) | F.coalesce("gap", F.lit(False))).alias("stopped"))
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return _started(log.writeStream.foreachBatch(each), checkpoint, available_now)


def apply_batch(store: MemoryStore, batch: DataFrame) -> int:
    """Apply one shard's rows to its store, as far as generations are contiguous; returns the store's generation.

    Rows up to the store's generation are duplicates and change nothing, which makes a repeated micro-batch harmless. Rows
    that cannot be read (blank id, no text to put) use their generation and change nothing.
    """
    ahead = batch.where(F.col("generation") > store.generation)
    numbered = running_max_before(ahead.withColumn("shard_id", F.lit(0)), ["shard_id"], [F.col("generation"), F.col("op"), F.col("document_id"), F.col("text")], "generation")
    stop = numbered.where(F.col("generation") > F.coalesce("before", F.lit(store.generation)) + 1).agg(F.min("generation")).first()[0]
    usable = ahead if stop is None else ahead.where(F.col("generation") < stop)
    last = usable.agg(F.max("generation")).first()[0]
    if last is None:
        return store.generation
    written = readable(usable.withColumn("shard_id", F.lit(0)))
    store.change(touched(written), compact(written), last)
    return store.generation


def apply_stream(log: DataFrame, stores: Callable[[int], MemoryStore], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start applying a streaming log to the store of each shard."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            shards = [r[0] for r in batch.select("shard_id").where(F.col("shard_id").isNotNull()).distinct().collect()]  # a row a shard
            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(lambda s: apply_batch(stores(s), batch.where(F.col("shard_id") == s)), shards))
        finally:
            batch.unpersist()

    return _started(log.writeStream.foreachBatch(each), checkpoint, available_now)


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
