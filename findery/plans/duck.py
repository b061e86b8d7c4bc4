"""The analyzer in DuckDB's SQL, for checking results.

DuckDB composes canonically but knows neither compatibility mappings nor full case folding, so these are built by rule from
Python's tables for the characters of the basic ranges: one-character mappings by ``translate``, longer ones that hold a
letter or digit by ``replace``. A term is then a run of letters and numbers.
"""

from __future__ import annotations

from functools import cache
from unicodedata import normalize

_RANGES = ((0x41, 0x3100), (0xA640, 0xA7FF), (0xF900, 0xFAFF), (0xFB00, 0xFB50), (0xFF00, 0xFFEF))


@cache
def _mappings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    one, to, more = [], [], []
    for low, high in _RANGES:
        for c in map(chr, range(low, high)):
            folded = normalize("NFKC", c).casefold()
            if folded == c or normalize("NFC", c) != c:
                continue
            if len(folded) == 1:
                one.append(c)
                to.append(folded)
            elif ord(c) < 0x2200 or 0xFB00 <= ord(c) <= 0xFB06:
                if any(x.isalnum() for x in folded):
                    more.append((c, folded))
    return "".join(one), "".join(to), tuple(more)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str) -> str:
    """SQL for the terms of the expression ``text``; null gives null."""
    one, to, more = _mappings()
    expression = f"nfc_normalize({text})"
    for a, b in more:
        expression = f"replace({expression}, {quoted(a)}, {quoted(b)})"
    return f"regexp_extract_all(translate({expression}, {quoted(one)}, {quoted(to)}), '[\\p{{L}}\\p{{N}}]+')"


def analyzed(name: str = "t", source: str = "documents") -> str:
    """A common table expression ``name`` with ``document_id, tokens`` (never null) and ``dl`` of all documents."""
    return f"{name} AS (SELECT document_id, coalesce({tokens('text')}, []) AS tokens, len(coalesce({tokens('text')}, [])) AS dl FROM {source})"


def index(source: str = "documents") -> str:
    """``t``, ``p`` (term, document_id, tf, dl), ``d`` (term, df) and ``s`` (n, total_len, avgdl)."""
    return (
        f"{analyzed(source=source)}, x AS (SELECT document_id, dl, unnest(tokens) AS term FROM t), "
        "p AS (SELECT term, document_id, count(*) AS tf, any_value(dl) AS dl FROM x GROUP BY term, document_id), "
        "d AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
        "s AS (SELECT count(*) AS n, coalesce(sum(dl), 0)::BIGINT AS total_len, sum(dl) / count(*) AS avgdl FROM t)"
    )


def idf(n: str, df: str) -> str:
    return f"ln(1.0::DOUBLE + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE))"


def scored(asked: str, k1: float = 1.2, b: float = 0.75) -> str:
    """After ``index()``: ``h`` (query_id, document_id, score) of the query ``asked`` (query_id, pos, term)."""
    value = f"{idf('s.n', 'd.df')} * (p.tf * ({k1}::DOUBLE + 1.0::DOUBLE)) / (p.tf + {k1}::DOUBLE * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * (p.dl / s.avgdl)))"
    return (
        f"q AS ({asked}), "
        f"c AS (SELECT q.query_id, p.document_id, q.pos, {value} AS v FROM q JOIN d ON d.term = q.term JOIN p ON p.term = q.term CROSS JOIN s), "
        "h AS (SELECT query_id, document_id, list_sum(list(v ORDER BY pos)) AS score FROM c GROUP BY query_id, document_id)"
    )


def words(*terms: str) -> str:
    """A query of literal terms, number 0."""
    return " UNION ALL ".join(f"SELECT 0::BIGINT AS query_id, {i} AS pos, '{t}' AS term" for i, t in enumerate(terms))


def labelled() -> str:
    """The terms of all labelled queries."""
    return f"SELECT query_id, pos, term FROM (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT query_id, {tokens('query')} AS w FROM labelled_queries))"


def ranked(name: str, source: str, score: str = "round(score, 9)") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, document_id) AS rank FROM {source})"


BLANK_ID = r"(document_id IS NULL OR regexp_full_match(document_id, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]*'))"

#: Valid vectors of doc_vectors as unit vectors of floats (``v``) and those of the labelled queries (``u``).
UNIT = (
    "u0 AS (SELECT {key}, {vector} AS a, sqrt(list_sum(list_transform({vector}, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM {table} "
    "WHERE {vector} IS NOT NULL AND len({vector}) = 64 AND len(list_filter({vector}, lambda x: isfinite(x))) = 64), "
    "{name} AS (SELECT {key} AS id, CASE WHEN n = 0 THEN a ELSE list_transform(a, lambda x: (x::DOUBLE / n)::FLOAT) END AS v FROM u0)"
)


def unit(name: str, table: str, key: str, vector: str) -> str:
    return UNIT.format(name=name, table=table, key=key, vector=vector).replace("u0", f"{name}0")


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
