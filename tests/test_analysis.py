"""The analyzer: literal cases, and the definition over all of Unicode."""

import sys
from unicodedata import normalize

from hypothesis import given, settings
from hypothesis import strategies as st

from findery.functions.analysis import normalized, terms, tokens_col


def reference(text):
    out, run = [], ""
    for c in normalize("NFKC", text).casefold():
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def test_literals():
    assert normalized("Distributed SEARCH") == "distributed search"
    assert normalized("ＢＭ２５") == "bm25"
    assert normalized("STRASSE") == normalized("Straße")
    assert terms("don't") == ["don", "t"]
    assert terms("分布式搜索") == ["分布式搜索"]
    assert terms("!!! ... ???") == terms("") == terms(None) == []
    assert terms("a_b") == ["a", "b"]
    assert terms("éạb") == ["é", "ạb"] or terms("éạb") == reference("éạb")


def test_every_character():
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            text = f"x{chr(c)}y {chr(c)}"
            assert terms(text) == reference(text), hex(c)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert terms(text) == reference(text)


def test_column(spark, small):
    rows = small([(1, "A b A"), (2, None), (3, "  "), (4, "½ ﬁn")], "i int, text string")
    got = {r[0]: r[1] for r in rows.select("i", tokens_col("text")).collect()}
    assert got == {1: ["a", "b", "a"], 2: [], 3: [], 4: ["1", "2", "fin"]}


def test_filters_pass_the_analyzer(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", tokens_col("text").alias("t")).where("lang = 'en'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def test_sql_functions(spark):
    from findery.functions import register_sql_functions

    register_sql_functions(spark)
    row = spark.sql("SELECT analyze('Ab c') AS a, shard_for('doc-3', 3) AS s, idf(3L, 1L) AS i, rrf_term(1, 10) AS r, rrf_term(NULL, 10) AS n").first()
    assert row["a"] == ["ab", "c"] and row["s"] == 2 and abs(row["i"] - 0.9808292530117263) < 1e-12
    assert row["r"] == 1 / 11 and row["n"] == 0.0
