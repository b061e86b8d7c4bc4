"""Near-duplicate records: pairs whose sets of word shingles have at least a given Jaccard similarity.

Method: a multi-index Hamming join. A record's signature has SYMBOLS minhash symbols; two records differ in each with
probability 1 - similarity, so near records have a small Hamming distance over symbols. The signature is split into chunks.
By the pigeonhole principle a pair within distance ``Keys.distance`` has a chunk with at most ``Keys.errors`` differing
symbols; all ways to miss so many of a chunk's symbols are enumerated as keys, and a join on equal keys therefore gives all
pairs within that distance. ``keys_for`` chooses chunks and errors for the similarity asked for, so that more than REACH of
the pairs of just that similarity share a key, and refuses a similarity (under about 0.36) for which less than LEAST_REACH
would. Records that share a key are compared by the b-bit form of the signature (b = 4: BITS bits a symbol in each of two
BIGINTs), and a pair is kept while its distance in b-bit symbols is within the guaranteed distance, or allows the similarity
if that is farther: no pair within the guaranteed distance is dropped. With b = 2 a tenth of the pairs that share three
symbols by chance were kept, whose number grows as the square of the records. What is left is verified on the full shingle
sets, as hashes of SHORT bytes.

Scale: records of equal shingle sets are one class and only its smallest key takes part; the class is found by an
aggregation that combines before its shuffle, so a group of copies of any size is one row. Keys of more than HOT records are
found by a count that combines before its shuffle; their records go another way: they are compared in blocks spread over the
tasks, 128 bits a comparison, and give only the near pairs that no key before gives. Of the other keys those that one
record alone has (nearly all) are dropped before the join. Candidates are verified in groups, to which each shingle set
goes once, however many pairs it is in; texts are never shuffled. Classes of many records are spread over tasks where pairs of records are asked for.
Nothing is capped.

Null texts, and texts of fewer than ``min_terms`` terms (or than a shingle needs), are in no pair; where every record is
asked for, those of equal terms are one class, and each null text is one of its own. Repeated texts are members of one
class. An empty table gives empty tables. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.analysis import terms
from findery.operators.membership import those_among
from findery.sources.scratch import materialize

SYMBOLS, BITS = 32, 2
#: The columns of the b-bit form.
SKETCHES = ("sketch", "second")
#: Share of the pairs of just the similarity asked for that share a key: aimed at, and the least that is accepted.
REACH, LEAST_REACH = 0.9995, 0.99
#: A bucket of more records than HOT is compared in blocks of BLOCK.
HOT, BLOCK = 200, 2000
#: Candidate pairs that are verified together.
TOGETHER = 5000
#: Keys up to this number are sent to every task (8 bytes each), more are joined by shuffle.
BROADCAST_KEYS = 1_000_000

#: So many characters tell of most texts that they have enough terms.
BEGINNING = 1000

#: Bytes of a shingle's hash that are compared; two different shingles of a pair of records agree once in about 10**9 pairs.
SHORT = 6

_BLOCK = 1024
_CACHE = 500_000
_SEEDS = np.random.default_rng(20240229).integers(0, 2**63, (2, SYMBOLS), dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class TermHashes(dict):
    """64-bit hash of a term, kept."""

    def __missing__(self, term: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[term] = xxhash.xxh64_intdigest(term)
        return h


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` tokens, given as 64-bit hashes."""
    n = len(tokens) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * _STEP + tokens[j : j + n]
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS 32-bit minhash symbols for each run of ``hashes`` that begins at one of ``starts``."""
    out = np.empty((len(starts), SYMBOLS), np.uint32)
    for i in range(SYMBOLS):
        out[:, i] = np.minimum.reduceat(((hashes * (_SEEDS[0, i] | np.uint64(1)) + _SEEDS[1, i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def packed(symbols: np.ndarray, at: int = 0) -> np.ndarray:
    """BITS bits of each symbol's mixed value, the highest (``at`` 0) or those after, as one signed 64-bit number a row."""
    low = (symbols * np.uint32(0x85EBCA6B) << np.uint32(BITS * at) >> np.uint32(32 - BITS)).astype(np.uint64)
    return (low << (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sets(batch: pa.RecordBatch, width: int, least: int, cache: TermHashes) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and sorted distinct shingle hashes of the records that have enough terms."""
    for at in range(0, batch.num_rows, _BLOCK):
        part = batch.slice(at, _BLOCK)
        keys, sets = [], []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            own = terms(text)
            if len(own) >= max(least, width):
                keys.append(key)
                sets.append(np.unique(shingle_hashes(np.fromiter(map(cache.__getitem__, own), np.uint64, len(own)), width)))
        yield keys, sets


def _may_be_near(most: int) -> Column:
    """Whether at most ``most`` of the b-bit symbols differ."""
    unlike = [F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in SKETCHES]
    x = reduce(Column.bitwiseOR, (F.shiftrightunsigned(u, shift) if shift else u for u in unlike for shift in range(BITS)))
    return F.bit_count(x.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(SYMBOLS))))) <= most


@dataclass(frozen=True)
class Keys:
    """``chunks`` of ``width`` symbols, of which all ways to miss ``errors`` are keys."""

    chunks: int
    width: int
    errors: int

    @property
    def distance(self) -> int:
        """Pairs within it share a key for certain."""
        return self.chunks * (self.errors + 1) - 1

    @property
    def chosen(self) -> list[tuple[int, ...]]:
        """The symbols of each key."""
        return [k for c in range(self.chunks) for k in combinations(range(c * self.width, (c + 1) * self.width), self.width - self.errors)]

    def reach(self, similarity: float) -> float:
        """Probability that a pair of this similarity shares a key."""
        one = sum(math.comb(self.width, e) * (1 - similarity) ** e * similarity ** (self.width - e) for e in range(self.errors + 1))
        return 1 - (1 - one) ** self.chunks


#: From few selective keys to many.
SHAPES = (Keys(4, 8, 1), Keys(8, 4, 1), Keys(8, 4, 2))


def keys_for(similarity: float) -> Keys:
    """The first shape that reaches REACH, else the last, if it reaches LEAST_REACH."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    shape = next((k for k in SHAPES if k.reach(similarity) >= REACH), SHAPES[-1])
    if shape.reach(similarity) < LEAST_REACH:
        raise ValueError(f"pairs of similarity {similarity} would be found with probability {shape.reach(similarity):.3f} only")
    return shape


def farthest(similarity: float) -> int:
    """Differing b-bit symbols that a pair of this similarity exceeds in fewer than 1 of 50,000 cases."""
    p = (1 - similarity) * (1 - 2.0 ** -(BITS * len(SKETCHES)))
    within = np.cumsum([math.comb(SYMBOLS, i) * p**i * (1 - p) ** (SYMBOLS - i) for i in range(SYMBOLS + 1)])
    return int(np.argmax(1 - within < 1 / 50_000))


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: key, class_id for every record that takes part; ``pairs``: class_a < class_b, similarity; ``others``:
    record, same for every record that takes no part, ``same`` telling its terms (null for a null text)."""

    members: DataFrame
    pairs: DataFrame
    others: DataFrame

    def record_pairs(self, key: str) -> DataFrame:
        """All pairs of records, ``<key>_a`` < ``<key>_b``: of near classes and within each class."""
        sizes = self.members.groupBy("class_id").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "class-sizes")
        large = sizes.where(F.col("blocks") > 1).select("class_id", "blocks")
        hint = F.broadcast if large.count() <= BROADCAST_KEYS else lambda df: df
        blocks = F.coalesce("blocks", F.lit(1))
        # a member is in one block of its class; whatever meets the class meets each block
        placed = self.members.join(hint(large), "class_id", "left").select("class_id", F.pmod(F.xxhash64(key), blocks).cast("int").alias("block"), key)
        every = lambda df, on: df.join(hint(large.withColumnRenamed("class_id", on)), on, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        one, two = (placed.select(F.col("class_id").alias(f"class_{x}"), "block", F.col(key).alias(f"{key}_{x}")) for x in "ab")
        first = every(self.pairs, "class_a").join(one, ["class_a", "block"]).select("class_b", f"{key}_a")
        across = every(first, "class_b").join(two, ["class_b", "block"]).select(f"{key}_a", f"{key}_b")
        copied = one.join(sizes.select(F.col("class_id").alias("class_a")), "class_a", "left_semi").drop("block")
        copies = every(copied, "class_a").withColumnRenamed("class_a", "class_b")
        inside = copies.join(two, ["class_b", "block"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
        both = across.unionByName(inside)
        return both.select(F.least(f"{key}_a", f"{key}_b").alias(f"{key}_a"), F.greatest(f"{key}_a", f"{key}_b").alias(f"{key}_b"))

    def groups(self, key: str, every: bool = False) -> DataFrame:
        """``<key>, class_id, group_id, links``: one row a record that takes part, or every record; the group is the smallest
        class id that links lead to."""
        ends = self.pairs.select(F.col("class_a").alias("v"), F.col("class_b").alias("w"))
        both = materialize(ends.unionByName(ends.select(F.col("w").alias("v"), F.col("v").alias("w"))), "links")
        degree = both.groupBy("v").agg(F.count("*").alias("links")).withColumnRenamed("v", "class_id")
        label = connected(both)
        linked = (
            self.members.join(label.withColumnRenamed("v", "class_id"), "class_id", "left")
            .join(degree, "class_id", "left")
            .select(key, "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )
        if not every:
            return linked
        others = materialize(self.others, "others")
        repeated = others.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("record").alias("class_id"), F.count("*").alias("size")).where(F.col("size") > 1).drop("size")
        class_id = F.coalesce("class_id", "record")
        alone = others.join(repeated, "same", "left").select(F.col("record").alias(key), class_id.alias("class_id"), class_id.alias("group_id"), F.lit(0).cast("bigint").alias("links"))
        return linked.unionByName(alone)


def connected(edges: DataFrame) -> DataFrame:
    """``v, label`` of symmetric ``edges`` (v, w): the smallest vertex reachable. Each round takes the least label of the
    neighbours and then jumps along labels, so rounds grow with the logarithm of the longest chain; each is written."""
    label = materialize(edges.groupBy("v").agg(F.least("v", F.min("w")).alias("label")), "label")
    while True:
        near = edges.join(label.select(F.col("v").alias("w"), F.col("label").alias("of_w")), "w").groupBy("v").agg(F.min("of_w").alias("seen"))
        step = label.join(near, "v").select("v", F.col("label").alias("before"), F.least("label", "seen").alias("label"))
        jump = label.select(F.col("v").alias("label"), F.col("label").alias("beyond"))
        new = materialize(step.join(jump, "label", "left").select("v", "before", F.least("label", "beyond").alias("label")), "label")
        moved = new.where(F.col("label") != F.col("before")).limit(1).count()
        label = new.select("v", "label")
        if not moved:
            return label


def near_duplicates(records: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, min_terms: int = 0) -> NearDuplicates:
    """Classes of equal shingle sets, and the pairs of classes of at least ``similarity``."""
    given = records.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    kind = dict(given.dtypes)[key]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TermHashes()
        for batch in batches:
            for keys, sets in _sets(batch, shingle, min_terms, cache):
                if not keys:
                    continue
                starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
                symbols = signatures(np.concatenate(sets), starts)
                equal = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(symbols.view(np.int32).ravel()), SYMBOLS).cast(pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(equal, pa.binary()), *(pa.array(packed(symbols, at)) for at in range(len(SKETCHES))), rows], ["record", "same", *SKETCHES, "symbols"])

    signed = materialize(given.mapInArrow(sign, f"record {kind}, same binary, {', '.join(f'{c} bigint' for c in SKETCHES)}, symbols array<int>"), "signatures")
    classes = signed.groupBy("same").agg(F.min(F.struct("record", *SKETCHES, "symbols")).alias("c"), F.count("*").alias("size"))
    first = classes.select(*(F.col(f"c.{c}").alias(c) for c in ("record", *SKETCHES, "symbols")), "same", "size")
    first = materialize(first, "classes")
    repeated = first.where(F.col("size") > 1).select("same", F.col("record").alias("class_id"))
    members = signed.select("same", F.col("record").alias(key)).join(repeated, "same", "left").select(key, F.coalesce("class_id", key).alias("class_id"))
    pairs = _verified(given, key, text, kind, _candidates(first, similarity), shingle, similarity, min_terms)
    return NearDuplicates(members, pairs, _others(records, key, text, kind, max(min_terms, shingle)))


def _others(records: DataFrame, key: str, text: str, kind: str, least: int) -> DataFrame:
    """``record, same`` of the records with fewer than ``least`` terms."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, same = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                # the cut can change the last term alone
                if t is not None and (len(terms(t[:BEGINNING])) > least or len(own := terms(t)) >= least):
                    continue
                at.append(i)
                same.append(None if t is None else xxhash.xxh3_128_digest(" ".join(own).encode()))
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(same, pa.binary())], ["record", "same"])

    return records.select(F.col(key), F.col(text)).mapInArrow(few, f"record {kind}, same binary")


def _candidates(first: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs a < b that share a key and are near in b-bit symbols."""
    shape, symbols = keys_for(similarity), F.col("symbols")
    most = max(shape.distance, farthest(similarity))
    keys = [F.xxhash64(*map(F.lit, k), *(symbols[i] for i in k)) for k in shape.chosen]
    buckets = F.explode(F.array(*keys)).alias("bucket")
    hot = materialize(first.select(buckets).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot-keys")
    hot_keys = hot.count()
    spread, hint = first.select("record", buckets), F.broadcast if hot_keys <= BROADCAST_KEYS else lambda df: df
    if hot_keys:
        spread = spread.join(hint(hot.select("bucket")), "bucket", "left_anti")
    shared = spread.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where(F.col("n") > 1).select("bucket", "record")
    shared = shared.join(first.select("record", *SKETCHES), "record")
    met = _met(materialize(shared, "shared-keys"), ["bucket"], most)
    if hot_keys:
        whole = first.select("record", *SKETCHES, "symbols", F.posexplode(F.array(*keys)).alias("at", "bucket"))
        met = met.unionByName(_in_blocks(whole.join(hint(hot), "bucket"), shape.chosen, most))
    return materialize(met.distinct(), "candidates")


def _met(buckets: DataFrame, by: list[str], most: int, other: DataFrame | None = None, also: Callable[[], Column] | None = None) -> DataFrame:
    """Pairs of one bucket that are near in b-bit symbols."""
    names = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))
    near = (F.col("record_a") < F.col("record_b")) & _may_be_near(most)
    keys = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in by]
    joined = names(buckets, "a").join(names(buckets if other is None else other, "b"), reduce(and_, keys) & (near if also is None else near & also()))
    return joined.select(F.col("record_a").alias("class_a"), F.col("record_b").alias("class_b"))


def _in_blocks(members: DataFrame, keys: list[tuple[int, ...]], most: int) -> DataFrame:
    """Pairs of the hot keys. Each key's ``members`` meet in blocks of BLOCK, spread over the tasks; a pair that shares
    several keys is given by the first of them alone, which its symbols tell."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # a given number of partitions, as few bytes make many comparisons here and would be put into one task
    tasks = max(64, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = members.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).repartition(tasks, "bucket", "block")
    two = members.withColumn("block", F.pmod(F.xxhash64("record"), blocks).cast("int")).repartition(tasks, "bucket", "block")

    def by_first_key() -> Column:
        equal = lambda i: F.col("symbols_a")[i] == F.col("symbols_b")[i]
        met_at = F
        for at, chosen in enumerate(keys):
            met_at = met_at.when(reduce(and_, map(equal, chosen)), at)
        return met_at == F.col("at_a")

    return _met(one, ["bucket", "block"], most, two, by_first_key)


def _verified(given: DataFrame, key: str, text: str, kind: str, candidates: DataFrame, shingle: int, similarity: float, min_terms: int) -> DataFrame:
    """Candidates with their exact similarity, where it is enough."""
    ids = candidates.select(F.explode(F.array("class_a", "class_b")).alias(key)).distinct()
    ids = materialize(ids, "candidate-ids")
    count = ids.count()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TermHashes()
        for batch in batches:
            for keys, sets in _sets(batch, shingle, min_terms, cache):
                yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array([_short(s) for s in sets], pa.binary())], ["record", "shingles"])

    met = given.join(F.broadcast(ids), key, "left_semi") if count <= BROADCAST_KEYS else those_among(given, ids, count, key)
    sets = met.mapInArrow(shingles, f"record {kind}, shingles binary")
    sides = max(1, math.ceil(math.sqrt(candidates.count() / TOGETHER)))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    grouped = candidates.select((side("class_a") * sides + side("class_b")).cast("int").alias("group"), "class_a", "class_b")
    needed = grouped.select("group", F.explode(F.array("class_a", "class_b")).alias("record")).distinct()
    held = needed.join(sets, "record").select("group", F.lit(False).alias("pair"), F.col("record").alias("class_a"), F.lit(None).cast(kind).alias("class_b"), "shingles")
    rows = held.unionByName(grouped.select("group", F.lit(True).alias("pair"), "class_a", "class_b", F.lit(None).cast("binary").alias("shingles")))
    placed = rows.repartitionById(sides * sides, F.col("group")) if sides * sides <= 4096 else rows.repartition(4096, "group")
    compared = placed.sortWithinPartitions("group", "pair").mapInArrow(_compare, f"class_a {kind}, class_b {kind}, similarity double")
    return compared.where(F.col("similarity") >= similarity)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of the pairs of each group; the group's sets come before its pairs."""
    of, sets = None, {}
    for batch in batches:
        group, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        a, b, shingles = (batch.column(i).to_pylist() for i in (2, 3, 4))
        share = []
        for i in range(batch.num_rows):
            if group[i] != of:
                of, sets = group[i], {}
            if pair[i]:
                x, y = sets[a[i]], sets[b[i]]
                common = len(x & y)
                share.append(common / (len(x) + len(y) - common))
            else:
                sets[a[i]] = frozenset(np.frombuffer(shingles[i], np.dtype((np.void, SHORT))).tolist())
        chosen = pa.array(np.flatnonzero(pair))
        yield pa.record_batch([batch.column(2).take(chosen), batch.column(3).take(chosen), pa.array(share, pa.float64())], ["class_a", "class_b", "similarity"])


def _short(hashes: np.ndarray) -> bytes:
    """A set's hashes in SHORT bytes each: sets are what is shuffled most."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()
