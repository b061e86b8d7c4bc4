"""The mutation log: reading it, sequencing, compaction, and changing what is derived from the corpus.

A log row is ``shard_id, generation, op, document_id, text``. Generations of a shard are a contiguous sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.operators.index import InvertedIndex, build_index
from findery.operators.running import HOT_ROWS, running_max_before
from findery.sources.corpus import blank
from findery.sources.scratch import materialize

#: Tables with a row a shard go to every task up to this number.
BROADCAST_SHARDS = 100_000
APPLIED, DUPLICATE, GAP, REFUSED = "applied", "duplicate", "gap", "refused"


def operation(op: Column) -> Column:
    """'put' or 'delete' whatever the case and blanks around; null for anything else."""
    name = F.lower(F.trim(op))
    return F.when(name.isin("put", "delete"), name)


def readable(log: DataFrame) -> DataFrame:
    """Log rows that can be applied: a shard, a generation, a known operation, an id that is not blank, a text to put."""
    known = log.withColumn("op", operation(F.col("op")))
    put = (F.col("op") == "delete") | F.col("text").isNotNull()
    return known.where(F.col("shard_id").isNotNull() & F.col("generation").isNotNull() & F.col("op").isNotNull() & ~blank(F.col("document_id")) & put)


def classify(log: DataFrame, arrival: list[Column], start: Column | None = None, stopped: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``log`` with ``outcome``, as each row is met in order of ``arrival`` (which must tell the rows of a shard apart).

    A shard begins at generation ``start`` (0), and may have ``stopped`` before (not). The next generation is applied, one up to the present is a duplicate, one
    beyond the next is a gap. From its first gap on a shard refuses to apply, though duplicates still succeed and what lies
    beyond is still a gap. Until the first gap the present generation is the largest met so far, so one running maximum
    classifies the whole log.
    """
    begin = F.lit(0) if start is None else start
    met = running_max_before(log.where(F.col("shard_id").isNotNull() & F.col("generation").isNotNull()), ["shard_id"], arrival, "generation", hot_rows)
    met = met.withColumn("_local", F.greatest(F.coalesce("before", begin), begin).cast("bigint"))
    # the first gap of a shard leaves it where it was then: all later maxima are larger
    stuck = met.where(F.col("generation") > F.col("_local") + 1).groupBy("shard_id").agg(F.min("_local").alias("_stuck"))
    stuck = materialize(stuck, "stuck-shards")
    both = met.join(F.broadcast(stuck) if stuck.count() <= BROADCAST_SHARDS else stuck, "shard_id", "left")
    already = F.lit(False) if stopped is None else stopped
    g, stopped = F.col("generation"), already | (F.col("_stuck").isNotNull() & (F.col("_local") > F.col("_stuck")))
    local = F.when(already, begin).when(stopped, F.col("_stuck")).otherwise(F.col("_local"))
    # all rows after the first gap have a larger maximum, since the gap's own generation is in it
    outcome = F.when(g <= local, DUPLICATE).when(g > local + 1, GAP).when(stopped, REFUSED).otherwise(APPLIED)
    return both.withColumn("outcome", outcome).drop("before", "_local", "_stuck")


def missing_generations(log: DataFrame) -> DataFrame:
    """``shard_id, first, last``: stretches of generations that no row of the log has, up to the shard's last."""
    seen = log.where(F.col("generation").isNotNull()).select("shard_id", "generation").distinct()
    met = running_max_before(seen, ["shard_id"], [F.col("generation")], "generation")
    return met.withColumn("before", F.coalesce("before", F.lit(0))).where(F.col("generation") > F.col("before") + 1).select("shard_id", (F.col("before") + 1).alias("first"), (F.col("generation") - 1).alias("last"))


def compact(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``<by>, text, generation`` of what a log leaves: the last operation of each key, deleted ones left out.

    ``by`` is ``document_id`` unless given. The aggregation combines before its shuffle, so a key that a third of the log
    writes is one row a task. Of different rows of one generation the larger operation and text counts.
    """
    by = by or ["document_id"]
    last = readable(log).groupBy(*by).agg(F.max(F.struct("generation", "op", "text")).alias("m"))
    return last.where(F.col("m.op") == "put").select(*by, F.col("m.text").alias("text"), F.col("m.generation").alias("generation"))


def touched(log: DataFrame) -> DataFrame:
    """Distinct ids that a log writes."""
    return readable(log).select("document_id").distinct()


def changed_index(index: InvertedIndex, documents: DataFrame, ids: DataFrame) -> InvertedIndex:
    """The index after ``ids`` were written: all their rows replaced by those of ``documents``, which has those that are left.

    Terms that no document has any more vanish, as postings are rows.
    """
    new = build_index(documents.join(ids.select("document_id"), "document_id", "left_semi"))
    keep = lambda df: df.join(ids.select("document_id"), "document_id", "left_anti").select(df.columns)
    return InvertedIndex(keep(index.postings).unionByName(new.postings, allowMissingColumns=True), keep(index.lengths).unionByName(new.lengths))


def changed_vectors(vectors: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors after ``ids`` were written; ``new`` has those of the documents that are left."""
    return vectors.join(ids.select("document_id"), "document_id", "left_anti").unionByName(new)


def upsert_outcomes(before: DataFrame, ids: DataFrame) -> DataFrame:
    """``document_id, created``: whether each id is new."""
    had = before.select("document_id", F.lit(False).alias("created"))
    return ids.select("document_id").distinct().join(had, "document_id", "left").select("document_id", F.coalesce("created", F.lit(True)).alias("created"))


def delete_outcomes(before: DataFrame, ids: DataFrame) -> DataFrame:
    """``document_id, deleted``: whether each id was there. A missing one uses no generation."""
    had = before.select("document_id", F.lit(True).alias("deleted"))
    return ids.select("document_id").distinct().join(had, "document_id", "left").select("document_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))


#: What a copy's generation says beside the primary's: by the sign of their difference, or None if either is unknown.
STANDING = {0: "ready", 1: "out_of_sync", -1: "recovering", None: "recovering"}


@dataclass(frozen=True)
class SyncDecision:
    """A copy's state beside its primary, and by how many generations it is behind (0 unless it can be brought up)."""

    state: str
    behind: int = 0

    @property
    def copy(self) -> bool:
        """Whether the primary's snapshot is to be taken over."""
        return self.behind > 0


def decide_sync(local: int, remote: int | None) -> SyncDecision:
    """``remote`` is None while nothing is known of the primary."""
    ahead = None if remote is None else local - remote
    sign = ahead if not ahead else ahead // abs(ahead)
    return SyncDecision(STANDING[sign], max(0, -(ahead or 0)))


def sync_state(local: Column, remote: Column) -> Column:
    """The state of ``decide_sync`` as a Column."""
    sign = F.signum((local - remote).cast("double")).cast("int")
    known = F.create_map(*(F.lit(x) for pair in STANDING.items() if pair[0] is not None for x in pair))
    return F.coalesce(known[sign], F.lit(STANDING[None]))
