"""Stores, formats, the mutation log, streaming, integrity, shards, the engine."""

import json
import logging
import os
import random
import sqlite3
import sys
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from findery.engine import SearchEngine
from findery.errors import DocumentNotFound, IdentityMismatch, InvalidDocument, InvalidTopology, NotReady, SemanticDisabled, ShardFailed, StorageError
from findery.functions.embedding import Identity, TokenTableEmbedder, table_embedder, TopicEmbedder, synthetic_text
from findery.functions.hashing import shard_for
from findery.functions.vectors import dot, l2_normalized
from findery.operations import JsonLines, parsed_topology
from findery.operators.index import InvertedIndex, build_index, totals
from findery.operators.invariants import engine_violations, index_violations, vector_violations
from findery.operators.membership import those_among, those_not_among
from findery.operators.mutations import changed_index, classify, compact, decide_sync, missing_generations, sync_state
from findery.operators.running import running_max_before, running_totals
from findery.operators.stored_index import StoredIndex
from findery.operators.sharding import cluster_health, require_all_shards, require_topology, serving_copies, shard_health, topology_faults
from findery.schema import MUTATIONS
from findery.sources import layers
from findery.sources.corpus import MemoryStore, SnapshotStore, blank, valid_documents
from findery.sources.formats import SqliteCorpus, read_corpus
from findery.plans import catalogue
from findery.sources.scratch import discard, materialize
from findery.streaming.mutations import apply_batch, apply_stream, classify_stream, outcomes, sequenced
from tests.oracles import rows_of, rows_of_sql

DOCS = "document_id string, text string"


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=["memory", "snapshot"])
def store(request, spark, tmp_path):
    return MemoryStore(spark) if request.param == "memory" else SnapshotStore(spark, f"file://{tmp_path}/store")


def test_store_contract(spark, store):
    assert store.count() == 0 and store.generation == 0 and store.get("a") is None
    assert pairs(store.put(spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], DOCS), 1)) == [("a", True), ("b", True)]
    assert pairs(store.put(spark.createDataFrame([("a", "one"), ("c", "")], DOCS), 2)) == [("a", False), ("c", True)]
    assert store.get("a") == "one" and store.generation == 2 and store.count() == 3
    assert pairs(store.delete(spark.createDataFrame([("b",), ("z",)], "document_id string"), 3)) == [("b", True), ("z", False)]
    assert pairs(store.scan()) == [("a", "one"), ("c", "")]
    with pytest.raises(InvalidDocument):
        store.put(spark.createDataFrame([(" ", "x")], DOCS), 4)
    with pytest.raises(InvalidDocument):
        store.replace_all(spark.createDataFrame([("a", None)], DOCS), 4)
    with pytest.raises(StorageError):
        store.replace_all(spark.createDataFrame([], DOCS), 1)
    assert store.generation == 3 and store.count() == 2
    store.replace_all(spark.createDataFrame([("q", "r")], DOCS), 9)
    assert pairs(store.scan()) == [("q", "r")] and store.generation == 9


def test_snapshots_are_immutable(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.replace_all(spark.createDataFrame([("a", "1")], DOCS), 1)
    before, generation = store.export()
    store.put(spark.createDataFrame([("b", "2")], DOCS), 2)
    assert pairs(before) == [("a", "1")] and generation == 1
    again = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert again.generation == 2 and again.count() == 2
    again.mark("degraded", "disk")
    with pytest.raises(NotReady):
        store.export()
    again.mark("ready")
    assert store.vacuum() == 0  # the change is a delta on the first snapshot
    store.replace_all(store.scan(), 3)
    assert store.vacuum() == 2 and store.count() == 2 and store.generation == 3
    with pytest.raises(ValueError):
        store.mark("odd")


def written(folder, before=()):
    """Bytes of the Parquet files that are not in ``before``, and all files."""
    files = {str(p) for p in folder.rglob("*.parquet")}
    return sum(os.path.getsize(f) for f in files - set(before)), files


def test_a_change_writes_what_it_changes(spark, tmp_path):
    docs = spark.range(4000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat_ws(" ", F.lit("common"), F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.replace_all(docs, 1)
    whole, files = written(tmp_path)
    store.put(spark.createDataFrame([("d7", "seven"), ("new", "common")], DOCS), 2)
    few, files = written(tmp_path, files)
    assert few < whole / 100 and store.count() == 4001 and store.get("d7") == "seven"
    store.delete(spark.createDataFrame([("d7",), ("d8",)], "document_id string"), 3)
    assert written(tmp_path, files)[0] < whole / 100 and store.count() == 3999 and store.get("d7") is None and store.get("d9")
    assert len(store.manifest().deltas) == 2
    for g in range(4, 20):  # deltas are merged before there are many
        store.put(spark.createDataFrame([(f"d{g}", f"text {g}"), ("again", str(g))], DOCS), g)
    assert len(store.manifest().deltas) <= layers.MOST_LAYERS and store.count() == 4002 and store.get("again") == "19" and store.get("d4") == "text 4" and store.get("d8") == "text 8"
    store.put(docs.limit(1500), 20)  # enough for a new snapshot
    assert store.manifest().deltas == [] and store.count() == 4002 and store.vacuum() > 10 and store.count() == 4002
    plan = store.scan().where("document_id = 'd5'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(document_id), EqualTo(document_id,d5)]" in plan


def test_layers():
    assert layers.mergeable([5] * layers.MOST_LAYERS) == layers.MOST_LAYERS
    assert layers.mergeable([5] * (layers.MOST_LAYERS + 1)) == 0
    falling = [9**i for i in range(layers.MOST_LAYERS, -2, -1) if i >= 0]
    assert layers.mergeable(falling) == len(falling) and layers.mergeable([*falling, 1]) == len(falling) - 1
    assert layers.outgrown(100_000, [15_000, 5001]) and not layers.outgrown(0, [900])


def test_stored_index_equals_a_new_one(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6)))
    now = {f"d{i}": text() for i in range(40)}
    frame = lambda: spark.createDataFrame(list(now.items()), DOCS)
    monkeypatch.setattr(layers, "MOST_LAYERS", 2)
    index = StoredIndex.build(frame())
    for turn in range(5):
        if turn == 4:
            monkeypatch.setattr(layers, "LEAST_ROWS", 3)
        touched = {f"d{rng.randrange(50)}" for _ in range(3)}
        for i in touched:
            if rng.random() < 0.3:
                now.pop(i, None)
            else:
                now[i] = text()
        index = index.changed(spark.createDataFrame([(i,) for i in touched], "document_id string"), frame())
        assert len(index.layers) <= 2
    fresh = build_index(frame())
    assert index.layers == () and pairs(index.index.postings) == pairs(fresh.postings) and pairs(index.lengths) == pairs(fresh.lengths)
    index = index.changed(spark.createDataFrame([("d1",)], "document_id string"), spark.createDataFrame([("d1", "a a z")], DOCS))
    now["d1"] = "a a z"
    fresh, some = build_index(frame()), index.lookup(["a", "z", "q"])
    assert pairs(some.postings) == pairs(fresh.postings.where("term in ('a', 'z')")) and index.totals == tuple(totals(fresh.lengths).first())
    plan = some.postings._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_blank_ids(spark):
    ids = [None, "", " ", "\t\n\x1c", " 　", "a", " a "]
    rows = spark.createDataFrame([(i,) for i in ids], "document_id string")
    assert [r[0] for r in rows.select(blank(F.col("document_id"))).collect()] == [i is None or not i.strip() for i in ids]
    assert valid_documents(spark.createDataFrame([("a", None), ("b", ""), (None, "x")], DOCS)).count() == 1


def test_formats(spark, tmp_path):
    rows = [("a", 'quote " and, comma\nand line'), ("b", ""), ("ü", "文")]
    docs = spark.createDataFrame(rows, DOCS)
    base = f"file://{tmp_path}"
    docs.write.parquet(f"{base}/parquet")
    docs.write.orc(f"{base}/orc")
    docs.write.json(f"{base}/json")
    docs.write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(f"{base}/csv")
    for f in ("parquet", "orc", "json"):
        assert pairs(read_corpus(spark, f"{base}/{f}", f)) == sorted(rows), f
    assert {r[0] for r in read_corpus(spark, f"{base}/csv", "csv").collect()} == {"a", "b", "ü"}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("x\ny")
    assert pairs(read_corpus(spark, f"{base}/texts", "text")) == [("one.txt", "x\ny")]
    with pytest.raises(ValueError):
        read_corpus(spark, base, "xml")


def test_csv_tells_empty_texts_from_nulls(spark, tmp_path):
    (tmp_path / "one.csv").write_text('document_id,text\n"a",""\n"b",\n"c","x"\n')
    assert {r[0]: r[1] for r in read_corpus(spark, f"file://{tmp_path}/one.csv", "csv").collect()} == {"a": "", "b": None, "c": "x"}
    assert {r[0]: r[1] for r in read_corpus(spark, f"file://{tmp_path}/one.csv", "csv", nullValue="x").collect()}["c"] is None


def test_format_roundtrips_keep_every_text(spark, tmp_path):
    rows = [("a", ""), ("b", None), ("c", " "), ("d", "x\ry\r\nz\n"), ("e", '"'), ("f", 'a\\'), ("g", '\\"'), ("h", '",\n'), ("i", "\ttab "), ("j", "null"), (" k", "\u2028\x85")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"file://{tmp_path}/documents")
    (file,) = (tmp_path / "documents").glob("*.parquet")
    file.rename(tmp_path / "documents.parquet")
    assert rows_of(catalogue.queries()["format_roundtrips"](spark, str(tmp_path))) == rows_of_sql(str(tmp_path), catalogue.oracle_sql()["format_roundtrips"])


def test_what_was_shuffled_for_a_table_is_deleted(spark):
    blocks = lambda: {str(b) for b in _blocks(spark) if str(b).startswith("shuffle")}
    before = blocks()
    made = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def _blocks(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
    while found.hasNext():
        yield found.next()


def test_rows_that_may_be_among_ids(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    got = [r["k"] for r in those_among(rows, rows.where("k % 10 = 0").select("k"), 4000, "k").select("k").collect()]
    assert {str(i) for i in range(0, 40_000, 10)} <= set(got) and len(got) == len(set(got)) < 8000
    assert those_among(rows, rows.where("false").select("k"), 0, "k").count() == 0
    others = those_not_among(rows, rows.where("k % 10 = 0").select("k"), 4000, "k")
    assert sorted(int(r["k"]) for r in others.collect()) == [i for i in range(40_000) if i % 10]


def test_discarded_tables_are_gone(spark):
    made = materialize(spark.range(3).toDF("k"), "discarded")
    path = made.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert os.path.exists(path)
    discard(made)
    assert not os.path.exists(path)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "one.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE documents (document_id TEXT PRIMARY KEY, text TEXT NOT NULL)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [(f"d{i}", f"t{i}") for i in range(25)])
        db.execute("DELETE FROM documents WHERE document_id = 'd7'")
    got = read_corpus(spark, path, "sqlite", rowsPerPartition="10")
    assert got.rdd.getNumPartitions() == 3 and pairs(got) == sorted((f"d{i}", f"t{i}") for i in range(25) if i != 7)
    spark.dataSource.register(SqliteCorpus)
    out = str(tmp_path / "out")
    got.write.format("sqlite_corpus").option("path", out).mode("append").save()
    assert pairs(read_corpus(spark, out, "sqlite")) == pairs(got)


def test_sequencing():
    assert outcomes(4, False, [6, 5, 6])[:2] == (["gap", "refused", "gap"], 4)
    assert outcomes(4, False, [5, 6, 5]) == (["applied", "applied", "duplicate"], 6, False)


@pytest.mark.parametrize("hot", [10_000, 20])
def test_batch_classification_equals_the_state_machine(spark, hot):
    rng = random.Random(5)
    rows, want = [], []
    for shard in range(4):
        generations = [max(1, i // 2 + rng.choice([0, 0, 0, 0, 1]) * (shard > 1)) for i in range(1, 60)]
        for at, (g, o) in enumerate(zip(generations, outcomes(0, False, generations)[0])):
            rows.append((shard, g, at))
            want.append((shard, at, o))
    log = spark.createDataFrame(rows, "shard_id int, generation bigint, at int").repartition(3)
    got = classify(log, [F.col("at")], hot_rows=hot).select("shard_id", "at", "outcome")
    assert pairs(got) == sorted(want, key=repr)


LOG = [
    (0, 1, "put", "a", "one"), (0, 2, "PUT", "b", "two"), (0, 2, "put", "b", "two"), (0, 3, " Delete ", "a", None), (0, 5, "put", "a", "five"),
    (1, 1, "put", None, "x"), (1, 2, "put", "  ", "x"), (1, 3, "merge", "z", "x"), (1, 4, "put", "y", None), (1, None, "put", "y", "q"), (None, 1, "put", "n", "q"),
]


def test_log(spark):
    log = spark.createDataFrame(LOG, MUTATIONS)
    assert pairs(compact(log)) == [("a", "five", 5), ("b", "two", 2)]
    assert pairs(compact(log, ["shard_id", "document_id"])) == [(0, "a", "five", 5), (0, "b", "two", 2)]
    assert pairs(missing_generations(log.where("shard_id = 0"))) == [(0, 4, 4)]
    assert compact(log.where("false")).count() == 0


def test_incremental_index_equals_a_new_one(spark):
    before = spark.createDataFrame([("a", "x y"), ("b", "y z"), ("c", "q")], DOCS)
    after = spark.createDataFrame([("a", "x"), ("c", "q"), ("d", "new y")], DOCS)
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "document_id string")
    changed, fresh = changed_index(build_index(before), after, ids), build_index(after)
    assert pairs(changed.postings) == pairs(fresh.postings) and pairs(changed.lengths) == pairs(fresh.lengths)


def test_sync():
    assert [decide_sync(*x).state for x in ((3, 3), (4, 3), (2, 3), (2, None))] == ["ready", "out_of_sync", "recovering", "recovering"]
    assert decide_sync(2, 3).copy and decide_sync(2, 3).behind == 1 and not decide_sync(2, None).copy and not decide_sync(4, 3).copy


def test_sync_column(spark):
    rows = spark.createDataFrame([(3, 3), (4, 3), (2, 3), (2, None)], "l int, r int")
    assert [r[0] for r in rows.select(sync_state(F.col("l"), F.col("r"))).collect()] == ["ready", "out_of_sync", "recovering", "recovering"]


def stream_of(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, MUTATIONS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_sequencer(spark, tmp_path):
    rows = [(0, g, "put", f"d{g}", "t") for g in (2, 1, 3)] + [(1, 1, "put", "x", "t")]
    log = stream_of(spark, f"file://{tmp_path}/log", [rows])
    query = sequenced(log).writeStream.format("memory").queryName("sequenced").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert pairs(spark.sql("SELECT shard_id, generation, outcome FROM sequenced")) == [(0, 1, "applied"), (0, 2, "applied"), (0, 3, "applied"), (1, 1, "applied")]


def test_stream_classified_by_batch(spark, tmp_path):
    """Two micro-batches equal the state machine; a repeated one replaces what it wrote."""
    batches = [[(0, g, "put", f"d{g}", "t") for g in (2, 1, 2, 3)] + [(1, 2, "put", "x", "t"), (1, 1, "put", "y", "t"), (2, 2, "put", "z", "t")], [(0, 5, "put", "a", "t"), (0, 4, "delete", "b", None), (1, 4, "put", "c", "t"), (1, 5, "put", "c", "t"), (2, 1, "put", "q", "t"), (None, 1, "put", "q", "t")]]
    want, state = [], {}
    for rows in batches:
        for shard in {r[0] for r in rows} - {None}:
            generations = sorted(r[1] for r in rows if r[0] == shard)
            found, *state[shard] = outcomes(*state.get(shard, (0, False)), generations)
            want += [(shard, g, o) for g, o in zip(generations, found)]
    log = stream_of(spark, f"file://{tmp_path}/log", batches)
    classify_stream(log, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    assert pairs(spark.read.parquet(f"file://{tmp_path}/out/outcomes").select("shard_id", "generation", "outcome")) == sorted(want, key=repr)
    assert pairs(spark.read.parquet(f"file://{tmp_path}/out/state").where("batch = 1").drop("batch")) == sorted(((s, *x) for s, x in state.items()), key=repr)


def test_stream_applies_to_stores(spark, tmp_path):
    stores = {i: MemoryStore(spark) for i in range(2)}
    log = stream_of(spark, f"file://{tmp_path}/log", [[r for r in LOG if r[0] is not None and r[1] is not None]])
    apply_stream(log, stores.__getitem__, f"file://{tmp_path}/c").awaitTermination()
    assert pairs(stores[0].scan()) == [("b", "two")] and stores[0].generation == 3  # stops before the gap
    assert stores[1].count() == 0 and stores[1].generation == 4
    batch = spark.createDataFrame([r for r in LOG if r[0] == 0], MUTATIONS)
    assert apply_batch(stores[0], batch) == 3 and stores[0].count() == 1  # again, nothing changes


def test_index_violations(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", "")], DOCS)
    good = build_index(docs)
    assert index_violations(good, 4).count() == 0 and engine_violations(docs, good).count() == 0
    assert index_violations(good, 5).first()["rule"] == "total"
    worse = InvertedIndex(good.postings.where("term != 'x'").withColumn("tf", F.col("tf") - 1), good.lengths.where("document_id != 'b'"))
    assert {r["rule"] for r in index_violations(worse).collect()} == {"unknown document", "term frequency", "length"}
    twice = InvertedIndex(good.postings.union(good.postings), good.lengths.union(good.lengths))
    assert {"posting twice", "document twice"} <= {r["rule"] for r in index_violations(twice).collect()}
    assert {r["rule"] for r in engine_violations(docs, worse, generations=(1, 2)).collect()} == {"not indexed", "stale length", "stale posting", "generation"}


def test_vector_violations(spark):
    rows = [("ok", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None), ("wide", [1.0, 0.0, 0.0]), ("nan", [float("nan"), 0.0]), ("inf", [float("inf"), 0.0]), ("long", [2.0, 0.0]), ("twice", [0.0, 1.0]), ("twice", [0.0, 1.0])]
    got = pairs(vector_violations(spark.createDataFrame(rows, "document_id string, vector array<float>"), 2))
    assert got == sorted([("null", "null"), ("width", "wide"), ("not finite", "nan"), ("not finite", "inf"), ("norm", "long"), ("vector twice", "twice")], key=repr)


def test_routing():
    ids = {"doc-1": 1, "doc-2": 2, "doc-3": 2, "doc-4": 2, "doc-5": 1, "doc-6": 2, "": 0, "a": 2, "分布式搜索": 0}
    assert {i: shard_for(i, 3) for i in ids} == ids
    with pytest.raises(ValueError):
        shard_for("a", 0)


COPIES = "shard_id int, copy_no int, copy_role string, node_state string, endpoint string"


def test_health(spark):
    rows = [(0, 0, "primary", "degraded", "e"), (0, 1, "replica", "ready", "e"), (1, 0, "primary", "ready", "e"), (1, 1, "replica", "ready", None)]
    copies = spark.createDataFrame(rows, COPIES)
    assert pairs(shard_health(copies)) == [(0, 2, 1, True, False), (1, 2, 1, True, True)]
    assert tuple(cluster_health(copies).first()) == (2, 2, True, False)
    assert pairs(serving_copies(copies)) == [(0, 1), (1, 0)]
    require_all_shards(copies)
    require_topology(copies)
    with pytest.raises(ShardFailed):
        require_all_shards(copies.withColumn("node_state", F.lit("starting")))
    odd = spark.createDataFrame([(0, 0, "primary", "ready", "e"), (2, 0, "replica", "ready", "e"), (2, 1, "replica", "ready", "e")], COPIES)
    assert pairs(topology_faults(odd)) == [("copies", 0), ("position", 2), ("primary", 2)]
    with pytest.raises(InvalidTopology):
        require_topology(odd)


def test_running(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 70)).alias("g"), (F.col("id") * 7919 % 13).alias("x"), F.col("id").alias("k"))
    order, values = [F.desc("x"), F.col("k")], {"s": lambda p: 1.0 / (60 + p), "t": lambda _: F.col("k") * 1.0}
    figures = lambda df: {r["k"]: (r["position"], r["in_group"], *(round(r[c], 9) for c in ("s", "s_all", "t", "t_all"))) for r in df.collect()}
    assert figures(running_totals(rows, ["g"], order, values, hot_rows=100)) == figures(running_totals(rows, ["g"], order, values))
    highest = lambda df: {r["k"]: r["before"] for r in df.collect()}
    assert highest(running_max_before(rows, ["g"], order, "k", hot_rows=100)) == highest(running_max_before(rows, ["g"], order, "k"))


def test_embedders(spark):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", ""), ("c", "cat cat unknown")], DOCS)
    topic = TopicEmbedder((("cat",), ("dog", "wolf")))
    got = {r[0]: [round(x, 4) for x in r[1]] for r in topic.embed(docs).collect()}
    assert got["b"] == [0.0, 0.0, 1.0] and got["a"][0] == got["a"][1] > got["a"][2] > 0
    table = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "token string, vector array<double>")
    mean = TokenTableEmbedder(table, Identity("table", "t", "1", 2))
    got = {r[0]: [round(x, 4) for x in r[1]] for r in mean.embed(docs).collect()}
    assert got == {"a": [0.7071, 0.7071], "b": [0.0, 0.0], "c": [1.0, 0.0]}
    assert Identity("i", "m", "r", 3).fingerprint == "i:m@r/d3/l2"
    assert spark.range(1).select(synthetic_text(F.lit(1), ["a", "b", "c"], 4)).first()[0] == "b c a b"
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(l2_normalized(F.col("v"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], None]
    assert v.select(dot(F.col("v"), F.col("v"))).first()[0] == 25.0


def test_stored_embedder(spark, tmp_path):
    spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "token string, vector array<float>").write.parquet(f"file://{tmp_path}/models/pets/r2")
    model = table_embedder(spark, f"file://{tmp_path}/models", "pets", "r2")
    assert model.identity.fingerprint == "table:pets@r2/d2/l2"
    assert pairs(model.embed(spark.createDataFrame([("a", "cat cat")], DOCS)))[0][1] == [1.0, 0.0]
    with pytest.raises(AnalysisException):
        table_embedder(spark, f"file://{tmp_path}/models", "pets", "r3")
    spark.createDataFrame([("cat", [1.0]), ("dog", [0.0, 1.0])], "token string, vector array<float>").write.parquet(f"file://{tmp_path}/models/pets/r4")
    with pytest.raises(ValueError):
        table_embedder(spark, f"file://{tmp_path}/models", "pets", "r4")


def test_topology_text(spark):
    got = pairs(parsed_topology(spark, " a:1, b:1 ,", "a:2,a:3 ; b:2,,b:3"))
    assert got == [(0, 0, "primary", "ready", "a:1"), (0, 1, "replica", "ready", "a:2"), (0, 2, "replica", "ready", "a:3"), (1, 0, "primary", "ready", "b:1"), (1, 1, "replica", "ready", "b:2"), (1, 2, "replica", "ready", "b:3")]
    assert parsed_topology(spark, "a,b,c").count() == 3 and parsed_topology(spark, "").count() == 0
    require_topology(parsed_topology(spark, "a:1,b:1", "a:2;b:2"))
    for bad in (("a,b", "c"), ("a,a", "")):
        with pytest.raises(InvalidTopology):
            parsed_topology(spark, *bad)


def test_log_lines():
    record = logging.makeLogRecord({"name": "n", "levelname": "INFO", "msg": "took %d", "args": (3,), "created": 0.0, "shard": 2, "odd": {1}})
    assert json.loads(JsonLines().format(record)) == {"timestamp": "1970-01-01T00:00:00+00:00", "level": "INFO", "logger": "n", "message": "took 3", "shard": 2, "odd": "{1}"}
    try:
        raise ValueError("zwei\nZeilen")
    except ValueError:
        record.exc_info = sys.exc_info()
    line = JsonLines().format(record)
    assert "\n" not in line and "zwei" in json.loads(line)["exception"]


def test_engine(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/engine")
    engine = SearchEngine(spark, store, TopicEmbedder((("cat", "feline"), ("dog",))), shards=3)
    outcome = pairs(engine.upsert(spark.createDataFrame([("a", "cat nap"), ("b", "dog walk"), ("c", "feline")], DOCS)))
    assert [(i, created) for i, created, _ in outcome] == [("a", True), ("b", True), ("c", True)] and outcome[0][2] == shard_for("a", 3)
    hits, total = engine.search("cat", 5)
    assert [(r["document_id"], r["text"]) for r in hits.collect()] == [("a", "cat nap")] and total == 1
    hits, total = engine.semantic_search("feline", 2)
    assert [r["document_id"] for r in hits.collect()] == ["a", "c"] and total == 3
    hits, total = engine.hybrid_search("cat", 10, explain=True)
    first = hits.first()
    assert first["document_id"] == "a" and first["lexical_rank"] == 1 and first["lexical_score"] > 0 and total == 3
    assert engine.search("...")[1] == 0 and engine.hybrid_search("...")[1] == 0
    assert pairs(engine.upsert(spark.createDataFrame([("a", "bird")], DOCS)))[0][:2] == ("a", False)
    assert engine.search("cat")[1] == 0 and engine.search("bird")[1] == 1
    generation = engine.status()["generation"]
    assert pairs(engine.delete(["zzz"])) == [("zzz", False)] and engine.status()["generation"] == generation
    assert pairs(engine.delete(spark.createDataFrame([("a",), ("zzz",)], "document_id string"))) == [("a", True), ("zzz", False)] and engine.status()["generation"] == generation + 1
    assert engine.violations().count() == 0 and engine.stats().first()["n"] == 2 and engine.cluster_stats().first()["n"] == 2
    assert {r["term"]: r["df"] for r in engine.corpus_stats(["dog", "x"]).collect()} == {"dog": 1, "x": 0}
    assert pairs(engine.vector_ids()) == [("b",), ("c",)]
    shards, whole = engine.cluster_status(spark.createDataFrame([(i, 0, "primary", "ready", "e") for i in range(3)], COPIES))
    assert shards.count() == 3 and whole.first()["search_available"] and whole.first()["n"] == 2
    with pytest.raises(DocumentNotFound):
        engine.get("a")
    with pytest.raises(InvalidDocument):
        engine.upsert(spark.createDataFrame([(" ", "x")], DOCS))
    with pytest.raises(ValueError):
        engine.search("cat", 101)
    with pytest.raises(IdentityMismatch):
        engine.semantic_search("cat", identity=Identity("other", "m", "r", 3))
    again = SearchEngine(spark, SnapshotStore(spark, f"file://{tmp_path}/engine"))
    assert pairs(again.export()[0]) == [("b", "dog walk"), ("c", "feline")] and again.export()[1] == engine.export()[1]
    with pytest.raises(SemanticDisabled):
        again.semantic_search("cat")
    with pytest.raises(SemanticDisabled):
        again.hybrid_search("cat")
    assert again.hybrid_search("!!")[1] == 0
    again.resynchronize(spark.createDataFrame([("n", "new")], DOCS), 50)
    assert again.search("new")[1] == 1 and again.status()["generation"] == 50
    again.state = "out_of_sync"
    with pytest.raises(NotReady):
        again.search("new")
