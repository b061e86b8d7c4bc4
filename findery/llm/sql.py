"""SQL for those queries of the subpackage that SQL can express; it checks results and is quadratic where it has to be."""

from __future__ import annotations

from findery.plans.duck import analyzed, dot, idf, tokens, unit

_BLANK = r"[\t\n\r \x{00A0}\x{3000}]"
_TRIM = "\t\n\r  　"


def _figures() -> str:
    """``df`` (field, term, df) and ``total`` (field, n) of both fields."""
    return (
        f"t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL), "
        "w AS (SELECT doc_id, unnest(tokens) AS term FROM t), "
        "e AS (SELECT shard_id, generation, unnest(map_entries(document_frequencies)) AS m FROM corpus_stats WHERE document_frequencies IS NOT NULL), "
        "l AS (SELECT shard_id, m.key AS term, arg_max(m.value, (generation, m.value)) AS v FROM e WHERE m.value IS NOT NULL GROUP BY shard_id, term), "
        "df AS (SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df FROM w GROUP BY term UNION ALL SELECT 'document_frequencies', term, sum(v)::BIGINT FROM l GROUP BY term), "
        "total AS (SELECT 'text' AS field, count(*) AS n FROM t UNION ALL SELECT 'document_frequencies', coalesce(sum(c), 0)::BIGINT FROM (SELECT arg_max(document_count, (generation, document_count)) AS c FROM corpus_stats GROUP BY shard_id))"
    )


def _distinctive() -> str:
    return (
        f"WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL), "
        "w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL), "
        "f AS (SELECT term, count(*) AS df FROM w GROUP BY term), "
        f"a AS (SELECT 'text' AS field, doc_id AS record_id, w.term, round(tf * {idf('(SELECT count(*) FROM t)', 'df')}, 9) AS s, 3 AS k FROM w JOIN f ON w.term = f.term), "
        "r AS (SELECT query_id, shard_id, arg_max({'n': document_count, 'm': document_frequencies}, (generation, collected_at, document_count)) AS x FROM corpus_stats WHERE document_frequencies IS NOT NULL GROUP BY ALL), "
        "n AS (SELECT query_id, sum(x.n) AS n FROM r GROUP BY query_id), "
        "m AS (SELECT query_id, e.key AS term, sum(e.value) AS df FROM (SELECT query_id, unnest(map_entries(x.m)) AS e FROM r) GROUP BY ALL HAVING sum(e.value) > 0), "
        f"q AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM labelled_queries) GROUP BY ALL), "
        f"b AS (SELECT 'document_frequencies' AS field, m.query_id AS record_id, m.term, round(q.tf * {idf('n.n', 'm.df')}, 9) AS s, 1 AS k FROM m JOIN n ON m.query_id = n.query_id JOIN q ON q.query_id = m.query_id AND q.term = m.term), "
        "z AS (SELECT *, row_number() OVER (PARTITION BY field, record_id ORDER BY s DESC, term) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) "
        "SELECT field, record_id, term FROM z WHERE p <= k"
    )


def _near_duplicates() -> str:
    return (
        f"WITH {analyzed()}, d AS (SELECT doc_id, tokens, dl FROM t JOIN documents USING (document_id) WHERE dl >= 20), "
        "g AS (SELECT DISTINCT doc_id, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS s FROM (SELECT doc_id, tokens, unnest(range(1, dl - 1)) AS i FROM d)), "
        "c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), "
        "p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL) "
        "SELECT doc_id_a, doc_id_b FROM p JOIN c ca ON ca.doc_id = doc_id_a JOIN c cb ON cb.doc_id = doc_id_b WHERE shared / (ca.n + cb.n - shared)::DOUBLE >= 0.7"
    )


def _ngrams() -> str:
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n}::INT AS n, array_to_string(tokens[i : i + {n - 1}], ' ') AS term FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + {2 - n})) AS i FROM t)" for n in (1, 2, 3)
    )
    return f"WITH t AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL), g AS ({grams}) SELECT term, n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY term, n HAVING count(*) > 1"


def _nearest(chosen: str) -> str:
    valid = "(SELECT * FROM doc_vectors WHERE len(list_filter(vector, lambda x: x <> 0)) > 0)"
    exact = "list_transform(a, lambda x: x::DOUBLE / n)"
    u = unit("dv", valid, "vec_id", "vector").replace("CASE WHEN n = 0 THEN a ELSE list_transform(a, lambda x: (x::DOUBLE / n)::FLOAT) END", exact)
    return (
        f"WITH {u}, m AS (SELECT a.id AS a, b.id AS b, round({dot('a.v', 'b.v')}, 6) AS s FROM dv a JOIN dv b ON a.id <> b.id), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM m) "
        f"SELECT {chosen} FROM r WHERE k <= 5"
    )


def _boundaries() -> str:
    def fits(pieces: str) -> str:
        return f"len(list_filter({pieces}, lambda x: length(trim(x, '{_TRIM}')) > 2000)) = 0"

    paragraphs = rf"regexp_split_to_array(text, '\n{_BLANK}*\n')"
    lines = r"regexp_split_to_array(text, '\n')"
    marked = rf"regexp_replace(regexp_replace(text, '([.!?])({_BLANK})', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g')"
    sentences = rf"regexp_split_to_array({marked}, '[\n\x01]')"
    words = f"regexp_split_to_array(text, '{_BLANK}+')"
    return (
        f"SELECT doc_id, CASE WHEN {fits(paragraphs)} THEN 'paragraph' WHEN {fits(lines)} THEN 'line' WHEN {fits(sentences)} THEN 'sentence' WHEN {fits(words)} THEN 'word' ELSE 'hard' END AS boundary "
        "FROM documents WHERE length(text) > 2000"
    )


def _fused() -> str:
    lists = " UNION ALL ".join(
        f"SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id) AS p FROM (SELECT query_id, document_id, max({c}) AS s FROM hybrid_hits WHERE {c} IS NOT NULL AND NOT isnan({c}) GROUP BY ALL)"
        for c in ("lexical_score", "semantic_score")
    )
    return (
        f"WITH l AS ({lists}), f AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + p)), 12) AS s FROM l GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id) AS k FROM f) SELECT query_id, document_id FROM r WHERE k <= 10"
    )


def _flows() -> str:
    """All pairs of a query's documents, for each score."""
    lists = " UNION ALL ".join(
        f"SELECT '{c}' AS l, query_id, document_id, 1.0::DOUBLE - ((2 * rank() OVER (PARTITION BY query_id ORDER BY s DESC) + count(*) OVER (PARTITION BY query_id, s) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY query_id) AS u "
        f"FROM (SELECT query_id, document_id, max({c}) AS s FROM hybrid_hits WHERE {c} IS NOT NULL AND NOT isnan({c}) AND document_id IS NOT NULL GROUP BY ALL)"
        for c in ("lexical_score", "semantic_score")
    )
    preference = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({a}.u - {b}.u - 0.05::DOUBLE) / 0.45::DOUBLE))"
    return (
        f"WITH l AS ({lists}), d AS (SELECT DISTINCT query_id, document_id FROM l), n AS (SELECT query_id, count(*) AS items FROM d GROUP BY query_id), "
        "m AS (SELECT d.query_id, d.document_id, k.l, coalesce(l.u, 0.0::DOUBLE) AS u FROM d CROSS JOIN (SELECT DISTINCT l FROM l) k LEFT JOIN l ON l.l = k.l AND l.query_id = d.query_id AND l.document_id = d.document_id), "
        f"p AS (SELECT a.query_id, a.document_id, sum({preference.format(a='a', b='b')}) AS plus, sum({preference.format(a='b', b='a')}) AS minus FROM m a JOIN m b ON a.query_id = b.query_id AND a.l = b.l GROUP BY ALL), "
        "s AS (SELECT query_id, sum(u) AS u FROM m GROUP BY query_id) "
        "SELECT p.query_id, document_id, round(plus / greatest(items - 1, 1), 9) AS positive, round(minus / greatest(items - 1, 1), 9) AS negative, round((plus - minus) / greatest(items - 1, 1), 9) AS net, round(s.u / items, 9) AS mean_utility, items FROM p JOIN n ON n.query_id = p.query_id JOIN s ON s.query_id = p.query_id"
    )


def _groups() -> str:
    """Classes of equal shingle sets or terms, links between classes, and what they lead to."""
    return (
        f"WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS w FROM documents), "
        "g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)), "
        "k AS (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS same FROM g GROUP BY doc_id UNION ALL SELECT doc_id, coalesce('#' || array_to_string(w, ' '), '?' || doc_id) FROM t WHERE w IS NULL OR len(w) < 5), "
        "c AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY same) AS class_id FROM k), "
        "x AS MATERIALIZED (SELECT g.doc_id, s FROM g JOIN c ON g.doc_id = c.doc_id WHERE c.doc_id = class_id), "
        "n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), "
        "b AS (SELECT a.doc_id AS v, b.doc_id AS w, count(*) AS m FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL), "
        "e AS MATERIALIZED (SELECT v, w FROM b JOIN n p ON p.doc_id = v JOIN n q ON q.doc_id = w WHERE m / (p.n + q.n - m)::DOUBLE >= 0.8), "
        "r AS (SELECT v, v AS label FROM e UNION SELECT e.v, r.label FROM e JOIN r ON r.v = e.w WHERE r.label < e.v), "
        "h AS (SELECT v, min(label) AS label FROM r GROUP BY v), d AS (SELECT v, count(*) AS links FROM e GROUP BY v), "
        "z AS (SELECT v, min(label) AS label FROM (SELECT e.v, h.label FROM e JOIN h ON h.v = e.w UNION ALL SELECT v, label FROM h) GROUP BY v) "
        "SELECT doc_id, class_id, coalesce(label, class_id) AS group_id, coalesce(links, 0) AS links FROM c LEFT JOIN z ON z.v = class_id LEFT JOIN d ON d.v = class_id"
    )


def _leaks() -> str:
    def runs(name: str, table: str, key: str) -> str:
        return f"{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {tokens('text')} AS w FROM {table} WHERE text IS NOT NULL)))"

    return f"WITH {runs('a', 'documents', 'doc_id')}, {runs('b', 'eval_passages', 'item_id')} SELECT DISTINCT doc_id, item_id FROM a JOIN b ON a.s = b.s"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_figures()} SELECT df.field, df.term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df JOIN total ON df.field = total.field WHERE df <= 2 OR df > 0.2::DOUBLE * n",
        "p1_ngrams": _ngrams(),
        "p2_found": _distinctive(),
        "p3_found": _near_duplicates(),
        "p3_groups": _groups(),
        "p4_found": _nearest("DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b"),
        "p4_hits": _nearest("a AS vec_id, b AS neighbour, s AS score, k::INT AS hit_rank"),
        "p5_found": _boundaries(),
        "p6_found": _fused(),
        "p6_flows": _flows(),
        "p8_found": _leaks(),
    }
