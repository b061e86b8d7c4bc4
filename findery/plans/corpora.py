"""Queries on the stored corpus, the mutation log, shards and integrity, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.engine import SearchEngine
from findery.functions.embedding import TopicEmbedder
from findery.functions.hashing import shard_col
from findery.operators import knn
from findery.operators.index import InvertedIndex, build_index, counted_index
from findery.operators.invariants import engine_violations, index_violations
from findery.operators.mutations import changed_vectors, classify, compact, delete_outcomes, missing_generations, operation, readable, sync_state, touched, upsert_outcomes
from findery.operators.running import running_totals
from findery.operators.sharding import cluster_health, routed, serving_copies, shard_health, topology_faults
from findery.operators.stored_index import StoredIndex
from findery.plans import duck
from findery.plans.lexical import WORDS
from findery.plans.retrieval import TOPICS
from findery.sources.corpus import SnapshotStore, blank, valid_documents
from findery.sources.formats import SqliteCorpus, read_corpus
from findery.sources.scratch import materialize, temporary
from findery.sources.tables import table
from findery.streaming.mutations import classify_stream

SHARDS = 8


def _log(spark, folder) -> DataFrame:
    return table(spark, folder, "mutations")


def full_scan(spark, folder):
    """Every document that the store's schema admits."""
    return valid_documents(table(spark, folder, "documents"))


def document_count(spark, folder):
    """How many there are."""
    return valid_documents(table(spark, folder, "documents")).agg(F.count("*").alias("n"))


def point_lookup(spark, folder):
    """One document by its id."""
    return table(spark, folder, "documents").where(F.col("document_id") == "doc-7").select("document_id", "text").limit(1)


def invalid_ids(spark, folder):
    """Log rows with a blank id."""
    return _log(spark, folder).where(blank(F.col("document_id"))).select("shard_id", "generation", operation(F.col("op")).alias("op")).distinct()


def compact_mutations(spark, folder):
    """The documents that the whole log leaves, by shard."""
    return compact(_log(spark, folder), ["shard_id", "document_id"])


def classify_generations(spark, folder):
    """Outcome of every log row as it was received."""
    arrival = [F.col("received_at"), F.col("generation")]
    log = _log(spark, folder).where(F.col("received_at").isNotNull())
    return classify(log, arrival).groupBy("shard_id", "outcome").agg(F.count("*").alias("n"), F.min("generation").alias("first"), F.max("generation").alias("last"))


def missing_stretches(spark, folder):
    """Generations that no row of the log has."""
    return missing_generations(_log(spark, folder))


def upsert_results(spark, folder):
    """Whether each document that the log puts is new to the corpus."""
    puts = readable(_log(spark, folder)).where(F.col("op") == "put")
    return upsert_outcomes(valid_documents(table(spark, folder, "documents")), puts)


def delete_results(spark, folder):
    """Whether each document that the log deletes is in the corpus."""
    gone = readable(_log(spark, folder)).where(F.col("op") == "delete")
    return delete_outcomes(valid_documents(table(spark, folder, "documents")), gone)


def _store(spark, folder) -> SnapshotStore:
    store = SnapshotStore(spark, temporary(spark, f"store-{uuid.uuid4().hex}"))
    store.replace_all(valid_documents(table(spark, folder, "documents")), 1)
    return store


def replace_all_snapshot(spark, folder):
    """The corpus written as a snapshot and read back, with its generation."""
    documents, generation = _store(spark, folder).export()
    return documents.withColumn("generation", F.lit(generation))


def delete_documents(spark, folder):
    """The corpus after all that the log deletes, stored."""
    store = _store(spark, folder)
    store.delete(readable(_log(spark, folder)).where(F.col("op") == "delete").select("document_id"), 2)
    return store.scan().select("document_id")


def apply_log(spark, folder):
    """The corpus after the whole log, stored."""
    store = _store(spark, folder)
    log = _log(spark, folder)
    store.change(touched(log), compact(log), 2)
    return store.scan()


def incremental_postings(spark, folder):
    """Document frequencies after the log, from the index before it and the written documents alone."""
    before = valid_documents(table(spark, folder, "documents"))
    ids, left = materialize(touched(_log(spark, folder)), "touched"), materialize(compact(_log(spark, folder)), "left")
    index = StoredIndex.build(before).changed(ids, left).index
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def stream_classification(spark, folder):
    """The log as a stream, classified by micro-batch: rows by shard and outcome."""
    name = uuid.uuid4().hex
    base = temporary(spark, f"stream-{name}")
    source = _log(spark, folder)
    log = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_directory(spark, folder))
    classify_stream(log, base, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/outcomes").groupBy("shard_id", "outcome").agg(F.count("*").alias("n"))


def _directory(spark, folder: str) -> str:
    """A folder that holds the log's files alone: the table's own, or a link of a copy where the table is one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/mutations.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return f"{folder}/mutations.parquet"
    copy = temporary(spark, f"log-{uuid.uuid4().hex}")
    table(spark, folder, "mutations").write.parquet(copy)
    return copy


def shard_routing(spark, folder):
    """The owning shard of every document that the log writes."""
    return routed(touched(_log(spark, folder)), SHARDS)


def shard_sizes(spark, folder):
    """Documents of every shard, of those that the log writes."""
    return routed(touched(_log(spark, folder)), SHARDS).groupBy("shard_id").agg(F.count("*").alias("n"))


def misrouted(spark, folder):
    """Log rows whose shard does not own their document."""
    log = readable(_log(spark, folder))
    return log.withColumn("owner", shard_col("document_id", SHARDS)).where(F.col("owner") != F.col("shard_id")).select("shard_id", "generation", "document_id", "owner").distinct()


def health_by_shard(spark, folder):
    """What each shard's copies can do."""
    return shard_health(table(spark, folder, "shard_copies"))


def health_of_cluster(spark, folder):
    """What all together can do."""
    return cluster_health(table(spark, folder, "shard_copies"))


def answering_copies(spark, folder):
    """The copy of each shard that answers."""
    return serving_copies(table(spark, folder, "shard_copies"))


def faults_of_topology(spark, folder):
    """Where the topology is uneven."""
    return topology_faults(table(spark, folder, "shard_copies"))


def synchronization(spark, folder):
    """For every answer of a shard, whether its generation is that of the shard's log."""
    last = _log(spark, folder).groupBy("shard_id").agg(F.max("generation").alias("remote"))
    local = table(spark, folder, "corpus_stats").select("shard_id", F.col("generation").alias("local")).distinct()
    return local.join(last, "shard_id", "left").select("shard_id", "local", "remote", sync_state(F.col("local"), F.col("remote")).alias("state"))


def _corrupted(spark, folder) -> InvertedIndex:
    """The index without the postings of one frequent term, and with those of another counted once more."""
    good = counted_index(table(spark, folder, "documents"))
    p = good.postings.where(F.col("term") != "failover")
    p = p.withColumn("tf", F.when(F.col("term") == "tokenizer", F.col("tf") + 1).otherwise(F.col("tf")))
    return InvertedIndex(p, good.lengths.where(F.col("document_id") != "doc-7"))


def index_invariant_violations(spark, folder):
    """What is wrong with an index that was damaged on purpose."""
    return index_violations(_corrupted(spark, folder)).distinct()


def index_is_sound(spark, folder):
    """Violations of the index as built, by rule; none."""
    return index_violations(counted_index(table(spark, folder, "documents"))).groupBy("rule").agg(F.count("*").alias("n"))


def engine_cross_checks(spark, folder):
    """Stale rows of the damaged index against the corpus, by rule."""
    return engine_violations(table(spark, folder, "documents"), _corrupted(spark, folder)).groupBy("rule").agg(F.count("*").alias("n"))


def sqlite_roundtrip(spark, folder):
    """The corpus written to SQLite files and read back."""
    path = temporary(spark, f"sqlite-{uuid.uuid4().hex}")
    spark.dataSource.register(SqliteCorpus)
    valid_documents(table(spark, folder, "documents")).write.format("sqlite_corpus").option("path", path).mode("append").save()
    return read_corpus(spark, path, "sqlite")


def format_roundtrips(spark, folder):
    """The corpus written as CSV, JSON and ORC and read back: rows, characters and a sum of hashes of ids and texts of each."""
    documents = valid_documents(table(spark, folder, "documents"))
    base = temporary(spark, f"formats-{uuid.uuid4().hex}")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "document_id", "text")), 1, 8), 16, 10).cast("bigint")
    exact = {"header": "true", "escape": '"', "quoteAll": "true", "lineSep": "\n", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    documents.write.options(**exact).csv(f"{base}/csv")
    documents.write.json(f"{base}/json")
    documents.write.orc(f"{base}/orc")
    each = [read_corpus(spark, f"{base}/{f}", f, **({"lineSep": "\n"} if f == "csv" else {})).agg(F.lit(f).alias("format"), F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.sum(digest).alias("digest")) for f in ("csv", "json", "orc")]
    return reduce(DataFrame.unionByName, each)


def _engine(spark, folder) -> SearchEngine:
    return SearchEngine(spark, _store(spark, folder), TopicEmbedder(TOPICS), shards=SHARDS)


def engine_search(spark, folder):
    """The ten best of one query by an engine on a stored corpus, after a change of one document and its return."""
    engine = _engine(spark, folder)
    documents = engine.documents
    engine.upsert(documents.where(F.col("document_id") == "doc-7").withColumn("text", F.lit("failover failover failover")))
    engine.upsert(documents.where(F.col("document_id") == "doc-7"))
    hits, _ = engine.search(" ".join(WORDS))
    return hits.select("document_id", F.round("score", 6).alias("score"), "rank", "text")


def engine_semantic(spark, folder):
    """The scores of the ten nearest documents by an engine with topics."""
    hits, _ = _engine(spark, folder).semantic_search("replica search failover", 10)
    return hits.select("rank", F.round("score", 5).alias("score"))


def engine_violations_none(spark, folder):
    """What integrity checks of an engine find after the log's changes; nothing."""
    engine = _engine(spark, folder)
    engine.upsert(compact(_log(spark, folder)).select("document_id", "text"))
    return engine.violations()


def engine_statistics(spark, folder):
    """The figures of an engine after all that the log puts and deletes."""
    engine, log = _engine(spark, folder), _log(spark, folder)
    left = materialize(compact(log), "left")
    engine.upsert(left.select("document_id", "text"))
    engine.delete(touched(log).join(left, "document_id", "left_anti"))
    return engine.stats().withColumn("avgdl", F.round("avgdl", 6))


def engine_cluster(spark, folder):
    """What the copies of all shards can do, with an engine's figures."""
    return _engine(spark, folder).cluster_status(table(spark, folder, "shard_copies"))[1].withColumn("avgdl", F.round("avgdl", 6))


def ordered_scan(spark, folder):
    """Every document's place in the order of ids."""
    documents = valid_documents(table(spark, folder, "documents")).select("document_id", F.lit(0).alias("all"))
    return running_totals(documents, ["all"], [F.col("document_id")], {}).select("document_id", "position")


def vector_containment(spark, folder):
    """Whether each document has a vector."""
    return knn.contains(table(spark, folder, "doc_vectors").where(F.col("document_id").isNotNull()), table(spark, folder, "documents").select("document_id"))


def vector_changes(spark, folder):
    """Ids with a vector after the log: those it deletes have none, those it puts get one."""
    log = _log(spark, folder)
    before = table(spark, folder, "doc_vectors").where(F.col("document_id").isNotNull() & F.col("vector").isNotNull()).select("document_id", "vector")
    fresh = TopicEmbedder(TOPICS).embed(compact(log))
    return changed_vectors(before, fresh, touched(log)).select("document_id", F.size("vector").alias("width"))


QUERIES = {
    f.__name__: f
    for f in (
        full_scan, document_count, point_lookup, invalid_ids, compact_mutations, classify_generations, missing_stretches, upsert_results, delete_results, replace_all_snapshot, delete_documents, apply_log,
        incremental_postings, stream_classification, shard_routing, shard_sizes, misrouted, health_by_shard, health_of_cluster, answering_copies, faults_of_topology, synchronization,
        index_invariant_violations, index_is_sound, engine_cross_checks, sqlite_roundtrip, format_roundtrips,
        engine_search, engine_semantic, engine_violations_none, engine_statistics, engine_cluster, ordered_scan, vector_containment, vector_changes,
    )
}


def sql() -> dict[str, str]:
    blank_id = duck.BLANK_ID
    good = f"SELECT document_id, text FROM documents WHERE NOT {blank_id} AND text IS NOT NULL"
    log = (
        "o AS (SELECT *, CASE WHEN lower(trim(op)) IN ('put', 'delete') THEN lower(trim(op)) END AS what FROM mutations), "
        f"r AS (SELECT shard_id, generation, what AS op, document_id, text FROM o WHERE shard_id IS NOT NULL AND generation IS NOT NULL AND what IS NOT NULL AND NOT {blank_id} AND (what = 'delete' OR text IS NOT NULL))"
    )

    def left(keys: str) -> str:
        return f"SELECT {keys}, arg_max(op, (generation, op, text)) AS op, arg_max(text, (generation, op, coalesce(text, ''))) AS text, max(generation) AS generation FROM (SELECT DISTINCT * FROM r) GROUP BY {keys}"

    applied = f"WITH {log}, g AS ({good}), m AS ({left('document_id')}), a AS (SELECT document_id, text FROM g WHERE document_id NOT IN (SELECT document_id FROM r) UNION ALL SELECT document_id, text FROM m WHERE op = 'put')"
    met = (
        "z AS (SELECT shard_id, generation, greatest(coalesce(max(generation) OVER (PARTITION BY shard_id ORDER BY received_at, generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS l FROM mutations WHERE received_at IS NOT NULL AND shard_id IS NOT NULL AND generation IS NOT NULL), "
        "st AS (SELECT shard_id, min(l) AS stuck FROM z WHERE generation > l + 1 GROUP BY shard_id), "
        "y AS (SELECT z.shard_id, generation, stuck IS NOT NULL AND l > stuck AS stopped, CASE WHEN stuck IS NOT NULL AND l > stuck THEN stuck ELSE l END AS l FROM z LEFT JOIN st ON z.shard_id = st.shard_id)"
    )
    damaged = (
        f"WITH {duck.index()}, bp AS (SELECT term, document_id, CASE WHEN term = 'tokenizer' THEN tf + 1 ELSE tf END AS tf, dl FROM p WHERE term <> 'failover'), bl AS (SELECT document_id, dl FROM t WHERE document_id <> 'doc-7'), "
        "sm AS (SELECT document_id, sum(tf) AS s FROM bp GROUP BY document_id)"
    )
    topics = [f"len(list_filter(tokens, lambda x: x IN ({', '.join(repr(w) for w in t)})))::DOUBLE" for t in TOPICS]
    ready = "coalesce(node_state = 'ready' AND endpoint IS NOT NULL, false)"
    health = f"SELECT shard_id, count(*) AS copies, count(CASE WHEN {ready} THEN 1 END) AS ready_copies, bool_or({ready}) AS search_available, bool_or({ready} AND coalesce(copy_role = 'primary', false)) AS write_available FROM shard_copies GROUP BY shard_id"
    return {
        "full_scan": good,
        "document_count": f"SELECT count(*) AS n FROM ({good})",
        "point_lookup": "SELECT document_id, text FROM documents WHERE document_id = 'doc-7' LIMIT 1",
        "invalid_ids": f"SELECT DISTINCT shard_id, generation, CASE WHEN lower(trim(op)) IN ('put', 'delete') THEN lower(trim(op)) END AS op FROM mutations WHERE {blank_id}",
        "compact_mutations": f"WITH {log}, m AS ({left('shard_id, document_id')}) SELECT shard_id, document_id, text, generation FROM m WHERE op = 'put'",
        "classify_generations": f"WITH {met} SELECT shard_id, CASE WHEN generation <= l THEN 'duplicate' WHEN generation > l + 1 THEN 'gap' WHEN stopped THEN 'refused' ELSE 'applied' END AS outcome, count(*) AS n, min(generation) AS first, max(generation) AS last FROM y GROUP BY 1, 2",
        "missing_stretches": "SELECT shard_id, b + 1 AS first, generation - 1 AS last FROM (SELECT shard_id, generation, coalesce(lag(generation) OVER (PARTITION BY shard_id ORDER BY generation), 0) AS b FROM (SELECT DISTINCT shard_id, generation FROM mutations WHERE generation IS NOT NULL)) WHERE generation > b + 1",
        "upsert_results": f"WITH {log}, g AS ({good}) SELECT DISTINCT r.document_id, g.document_id IS NULL AS created FROM r LEFT JOIN g ON r.document_id = g.document_id WHERE op = 'put'",
        "delete_results": f"WITH {log}, g AS ({good}) SELECT DISTINCT r.document_id, g.document_id IS NOT NULL AS deleted FROM r LEFT JOIN g ON r.document_id = g.document_id WHERE op = 'delete'",
        "replace_all_snapshot": f"SELECT document_id, text, 1 AS generation FROM ({good})",
        "delete_documents": f"WITH {log} SELECT document_id FROM ({good}) WHERE document_id NOT IN (SELECT document_id FROM r WHERE op = 'delete')",
        "apply_log": f"{applied} SELECT document_id, text FROM a",
        "incremental_postings": f"{applied}, w AS (SELECT document_id, unnest({duck.tokens('text')}) AS term FROM a), n AS (SELECT term, document_id, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM n GROUP BY term",
        "health_by_shard": health,
        "health_of_cluster": f"SELECT count(*) AS shards, count(CASE WHEN search_available THEN 1 END) AS ready_shards, bool_and(search_available) AS search_available, bool_and(write_available) AS write_available FROM ({health})",
        "answering_copies": f"SELECT shard_id, copy_no FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY CASE WHEN copy_role = 'primary' THEN 0 ELSE 1 END, copy_no) AS k FROM shard_copies WHERE {ready}) WHERE k = 1",
        "faults_of_topology": "SELECT 'copies' AS fault, shard_id FROM shard_copies GROUP BY shard_id HAVING count(*) <> (SELECT max(c) FROM (SELECT count(*) AS c FROM shard_copies GROUP BY shard_id)) UNION ALL SELECT 'primary', shard_id FROM shard_copies GROUP BY shard_id HAVING count(CASE WHEN copy_role = 'primary' THEN 1 END) <> 1 UNION ALL SELECT DISTINCT 'position', shard_id FROM shard_copies WHERE shard_id IS NULL OR shard_id < 0 OR shard_id >= (SELECT count(DISTINCT shard_id) FROM shard_copies)",
        "synchronization": "SELECT c.shard_id, c.generation AS local, m.remote, CASE WHEN m.remote IS NULL THEN 'recovering' WHEN c.generation = m.remote THEN 'ready' WHEN c.generation > m.remote THEN 'out_of_sync' ELSE 'recovering' END AS state FROM (SELECT DISTINCT shard_id, generation FROM corpus_stats) c LEFT JOIN (SELECT shard_id, max(generation) AS remote FROM mutations GROUP BY shard_id) m ON c.shard_id = m.shard_id",
        "index_invariant_violations": f"{damaged} SELECT DISTINCT 'unknown document' AS rule, document_id AS subject FROM bp WHERE document_id NOT IN (SELECT document_id FROM bl) UNION ALL SELECT 'length', bl.document_id FROM bl LEFT JOIN sm USING (document_id) WHERE bl.dl <> coalesce(s, 0)",
        "index_is_sound": f"WITH {duck.index()}, sm AS (SELECT document_id, sum(tf) AS s, min(dl) AS least, max(dl) AS most FROM p GROUP BY document_id) SELECT rule, count(*) AS n FROM (SELECT 'unknown document' AS rule FROM sm WHERE document_id NOT IN (SELECT document_id FROM t) UNION ALL SELECT 'term frequency' FROM p WHERE tf < 1 UNION ALL SELECT 'length' FROM t LEFT JOIN sm USING (document_id) WHERE dl <> coalesce(s, 0) UNION ALL SELECT 'length of a posting' FROM t JOIN sm USING (document_id) WHERE least <> dl OR most <> dl UNION ALL SELECT 'document twice' FROM t GROUP BY document_id HAVING count(*) > 1 UNION ALL SELECT 'posting twice' FROM p GROUP BY term, document_id HAVING count(*) > 1) GROUP BY rule",
        "engine_violations_none": f"WITH {log}, g AS ({good}), m AS ({left('document_id')}), a AS (SELECT g.document_id, coalesce(m.text, g.text) AS text FROM g LEFT JOIN m ON g.document_id = m.document_id AND m.op = 'put') SELECT 'document twice' AS rule, document_id AS subject FROM a GROUP BY document_id HAVING count(*) > 1",
        "engine_search": f"WITH g AS ({good}), {duck.index('g')}, {duck.scored(duck.words(*WORDS))}, {duck.ranked('k', 'h')} SELECT document_id, round(score, 6) AS score, rank, text FROM k JOIN g USING (document_id) WHERE rank <= 10",
        "engine_semantic": f"WITH g AS ({good}), {duck.analyzed(source='g')}, c AS (SELECT document_id, {topics[0]} AS a, {topics[1]} AS b, {topics[2]} AS c, {topics[3]} AS d FROM t), q AS (SELECT (a * 2 + b + 0.0625::DOUBLE) / (sqrt(a * a + b * b + c * c + d * d + 0.0625::DOUBLE) * sqrt(5.0625::DOUBLE)) AS s, document_id FROM c) SELECT row_number() OVER (ORDER BY s DESC)::INT AS rank, round(s, 5) AS score FROM q QUALIFY rank <= 10",
        "engine_statistics": f"{applied}, {duck.index('a')} SELECT n, (SELECT count(*) FROM d) AS vocabulary, total_len AS total_tokens, round(avgdl, 6) AS avgdl FROM s",
        "engine_cluster": f"WITH g AS ({good}), {duck.analyzed(source='g')} SELECT count(*) AS shards, count(CASE WHEN search_available THEN 1 END) AS ready_shards, bool_and(search_available) AS search_available, bool_and(write_available) AS write_available, (SELECT count(*) FROM t) AS n, (SELECT sum(dl)::BIGINT FROM t) AS total_tokens, (SELECT round(sum(dl) / count(*), 6) FROM t) AS avgdl FROM ({health})",
        "ordered_scan": f"SELECT document_id, row_number() OVER (ORDER BY document_id) AS position FROM ({good})",
        "vector_containment": "SELECT d.document_id, d.document_id IN (SELECT document_id FROM doc_vectors WHERE document_id IS NOT NULL) AS embedded FROM documents d",
        "vector_changes": f"WITH {log}, m AS ({left('document_id')}) SELECT document_id, len(vector)::INT AS width FROM doc_vectors WHERE vector IS NOT NULL AND document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM r) UNION ALL SELECT document_id, {len(TOPICS) + 1}::INT FROM m WHERE op = 'put'",
        "stream_classification": f"WITH {met.replace('ORDER BY received_at, generation', 'ORDER BY generation').replace('received_at IS NOT NULL AND ', '')} SELECT shard_id, CASE WHEN generation <= l THEN 'duplicate' WHEN generation > l + 1 THEN 'gap' WHEN stopped THEN 'refused' ELSE 'applied' END AS outcome, count(*) AS n FROM y GROUP BY 1, 2",
        "shard_routing": f"WITH {log}, o1 AS (SELECT document_id, mode(shard_id) AS shard_id FROM r GROUP BY document_id) SELECT document_id, shard_id FROM o1",
        "shard_sizes": f"WITH {log} SELECT shard_id, count(DISTINCT document_id) AS n FROM r GROUP BY shard_id",
        "misrouted": f"WITH {log}, o1 AS (SELECT document_id, mode(shard_id) AS owner FROM r GROUP BY document_id) SELECT DISTINCT r.shard_id, generation, r.document_id, owner FROM r JOIN o1 ON r.document_id = o1.document_id WHERE r.shard_id <> owner",
        "engine_cross_checks": f"{damaged} SELECT 'not indexed' AS rule, count(*) AS n FROM t WHERE document_id = 'doc-7' UNION ALL SELECT 'stale length', count(*) FROM t WHERE document_id = 'doc-7' UNION ALL SELECT 'stale posting', count(*) FROM p WHERE term IN ('failover', 'tokenizer')",
        "sqlite_roundtrip": good,
        "format_roundtrips": f"SELECT f.format, count(*) AS n, sum(length(text))::BIGINT AS characters, sum(('0x' || md5(document_id || '|' || text)[1:8])::BIGINT)::BIGINT AS digest FROM ({good}) CROSS JOIN (SELECT unnest(['csv', 'json', 'orc']) AS format) f GROUP BY f.format",
    }
