"""Vectors, rankings, encoding and wrong encodings: recall, brute force, exact round trips, held-out accuracy, edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.llm import encoding, neighbours, queries, sql
from findery.llm.encoding import CHAINS, garble, in_text, invert, name, train, wrongly_decoded
from findery.llm.graph import Graph
from findery.llm.neighbours import most_similar
from findery.llm.outranking import net_flow
from findery.llm.tokenizing import Encoder, decode, default_vocabulary, encode, read_ranks, serialized_model
from findery.sources.scratch import discard, materialize
from tests.oracles import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_query_runs_and_equals_its_sql(spark, key):
    columns, rows = rows_of(queries.queries()[key](spark, FOLDER))
    if key in sql.oracle_sql():
        assert (columns, rows) == rows_of_sql(FOLDER, sql.oracle_sql()[key])
    else:
        assert columns and rows


# 4


def vectors(n, seed, d=16, clusters=30):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float32)


def nearest(x, ids, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    order = np.argsort(ids)
    return {ids[a]: [ids[b] for b in order[np.argsort(-s[a][order], kind="stable")][:k]] for a in range(len(x))}


def frame(spark, x, ids):
    rows = [(int(i), [float(y) for y in v] if v is not None else None, 1, "h") for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "vec_id bigint, vector array<float>, id int, same string")


def recall(found, want):
    got = defaultdict(set)
    for r in found.collect():
        got[r["vec_id"]].add(r["neighbour"])
    assert all(len(got[i]) == len(w) for i, w in want.items())
    return np.mean([len(got[i] & set(w)) / len(w) for i, w in want.items()])


@pytest.mark.parametrize("n", [300, 3000])
def test_graph_recall(n):
    x = vectors(n, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    assert sorted(g.rows.tolist()) == list(range(n))
    _, found = g.search(x, 24)
    s = x @ x.T
    hits = [len(set(g.rows[found[i][:6]].tolist()) & set(np.argsort(-s[i])[:6].tolist())) / 6 for i in range(n)]
    assert np.mean(hits) > 0.97


@pytest.mark.parametrize(
    "changed",
    [
        {},
        {"SHARD_ROWS": 300, "MAX_SHARD_ROWS": 400},
        {"SHARD_ROWS": 100, "MAX_SHARD_ROWS": 150, "FANOUT": 3},  # a tree of several levels
        {"SHARD_ROWS": 100, "MAX_SHARD_ROWS": 150, "FANOUT": 3, "BROADCAST_BYTES": 0, "BROADCAST_NODES": 0},  # centres by shuffle
        {"SHARD_ROWS": 300, "MAX_SHARD_ROWS": 400, "MAX_ASKING": 200, "MAX_TASKS": 4},  # leaves held by several tasks
    ],
)
def test_recall_against_brute_force(spark, monkeypatch, changed):
    for name_, value in changed.items():
        monkeypatch.setattr(neighbours, name_, value)
    x, ids = vectors(1500, 2), list(range(5, 3005, 2))
    assert recall(most_similar(frame(spark, x, ids).repartition(3), width=16), nearest(x, np.array(ids), 5)) > 0.97


@pytest.mark.parametrize("k", [30, 100])
def test_any_k(spark, k):
    x, ids = vectors(500, 4), list(range(500))
    assert recall(most_similar(frame(spark, x, ids), width=16, k=k), nearest(x, np.array(ids), k)) > 0.97  # and k of each


def test_vectors_without_structure():
    """40,000 normal vectors of width 64 in 80 regions: routed and searched as the operator does it, 200 of them asking."""
    x = np.random.default_rng(6).normal(size=(40_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    regions = neighbours._regions(x, len(x), 5, neighbours.TARGET, 80)
    home = np.concatenate([regions.distances(x[i : i + 4096]).argmin(axis=1) for i in range(0, len(x), 4096)])
    asking = np.random.default_rng(7).choice(len(x), 200, replace=False)
    row, region, at_home = regions.asked(x[asking], 5)
    assert len(regions.centres) == 80 and at_home.sum() == 200
    hits = defaultdict(list)
    for leaf in range(80):
        shard, own = neighbours._Shard(5, neighbours.TARGET), np.flatnonzero(home == leaf)
        shard.add(pa.array(own), x[own], np.isin(own, asking))
        others = asking[row[(region == leaf) & ~at_home]]
        for b in [*shard.complete(), *(shard.answers(pa.array(others), x[others]) if len(others) else ())]:
            for q, h, s in zip(*(c.to_pylist() for c in b.columns)):
                hits[q].append((-round(s, 6), h))
    found = []
    for q in asking.tolist():
        sims = np.round(x @ x[q], 6)
        sims[q] = -9
        found.append(len({h for _, h in sorted(hits[q])[:5]} & set(np.lexsort((np.arange(len(x)), -sims))[:5].tolist())) / 5)
    assert np.mean(found) > 0.9


def test_stored_vectors_in_many_regions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 60)
    monkeypatch.setattr(neighbours, "MAX_SHARD_ROWS", 100)
    stored = spark.read.parquet("/root/testdata/sf0.01/doc_vectors.parquet")
    valid = [(r["vec_id"], r["vector"]) for r in stored.where(neighbours.valid_vector(F.col("vector"))).collect()]
    want = nearest(np.array([v for _, v in valid], np.float32), np.array([i for i, _ in valid]), 5)
    assert recall(most_similar(stored), want) > 0.95


def test_equal_vectors(spark):
    """A third of all rows is one direction, in different lengths."""
    x = vectors(300, 3)
    x[::3] = x[0] * np.linspace(0.5, 2, 100)[:, None]
    ids = np.random.default_rng(0).permutation(300)
    assert recall(most_similar(frame(spark, x, ids), width=16), nearest(x, ids, 5)) > 0.97
    copies = {r["vec_id"]: r["neighbour"] for r in most_similar(frame(spark, x, ids), width=16).where("hit_rank = 1 and score = 1.0").collect()}
    least = sorted(ids[::3])[:2]
    assert all(copies[i] == (least[0] if i != least[0] else least[1]) for i in ids[::3])


def test_copies_too_many_to_be_sent(spark, monkeypatch):
    x = vectors(300, 3)
    x[::3] = x[0]
    want = most_similar(frame(spark, x, range(300)), width=16).collect()
    monkeypatch.setattr(neighbours, "BROADCAST_NODES", 0)
    assert sorted(most_similar(frame(spark, x, range(300)), width=16).collect()) == sorted(want)


def test_tables_of_vectors_do_not_stay(spark, monkeypatch):
    """Vectors are not copied, and visits are deleted once they are used: what is left has ids, hashes and scores."""
    kept, whole = [], []

    def materialized(df, name, *more):
        made = materialize(df, name, *more)
        kept.append(made)
        whole.extend([made] if "v" in made.columns else [])
        return made

    def discarded(t):
        kept[:] = [k for k in kept if k is not t]
        discard(t)

    for name, value in {"SHARD_ROWS": 100, "MAX_SHARD_ROWS": 150, "FANOUT": 3, "materialize": materialized, "discard": discarded}.items():
        monkeypatch.setattr(neighbours, name, value)
    x, ids = vectors(1500, 2), list(range(1500))
    found = most_similar(frame(spark, x, ids), width=16)
    assert len(whole) > 2 and not [k for k in kept if "v" in k.columns]
    assert recall(found, nearest(x, np.array(ids), 5)) > 0.97


def test_vector_edge_cases(spark):
    bad = [None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    df = frame(spark, bad, range(5))
    assert most_similar(df, width=2).count() == 0 and most_similar(df.where("false"), width=2).count() == 0
    one = frame(spark, [*bad, [1.0, 2.0]], range(6))
    assert most_similar(one, width=2).count() == 0
    few = frame(spark, [*bad, [1.0, 2.0], [2.0, 4.0], [-1.0, 1e-30], [1e38, 1e38]], range(9))
    got = [(r["vec_id"], r["neighbour"], r["hit_rank"]) for r in most_similar(few, width=2).orderBy("vec_id", "hit_rank").collect()]
    assert [g for g in got if g[0] == 5] == [(5, 6, 1), (5, 8, 2), (5, 7, 3)] and len(got) == 12


# 6


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, document_id string, a double, b double, g string, i string")


def flows(rows, utility, q_, p_):
    preferred = lambda d: min(1, max(0, (d - q_) / (p_ - q_)))
    lists = defaultdict(lambda: [{}, {}])
    for q, d, a, b, *_ in rows:
        for at, v in enumerate((a, b)):
            if d is not None and v is not None and not math.isnan(v):
                lists[q][at][d] = max(v, lists[q][at].get(d, -math.inf))
    out = {}
    for q, two in lists.items():
        us, items = [utility(x) for x in two], {*two[0], *two[1]}
        for d in items:
            plus = sum(preferred(u.get(d, 0) - u.get(e, 0)) for u in us for e in items)
            minus = sum(preferred(u.get(e, 0) - u.get(d, 0)) for u in us for e in items)
            out[q, d] = (plus / max(1, len(items) - 1), minus / max(1, len(items) - 1))
    return out


def percentiles(scores):
    v = list(scores.values())
    return {d: 1 - ((sum(w > s for w in v) + 1 + sum(w >= s for w in v)) / 2 - 0.5) / len(v) for d, s in scores.items()}


def reciprocals(scores):
    return {d: 1 / (60 + p) for p, (d, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0])), 1)}


@pytest.mark.parametrize("scale, utility, thresholds", [("percentile", percentiles, (0.05, 0.5)), ("percentile", percentiles, (0.0, 1.0)), ("reciprocal", reciprocals, (0.001, 0.004))])
@pytest.mark.parametrize("hot", [200_000, 40])
def test_flows_against_all_pairs(spark, monkeypatch, scale, utility, thresholds, hot):
    import findery.llm.outranking as module
    from findery.operators.running import running_totals

    monkeypatch.setattr(module, "running_totals", lambda *a: running_totals(*a, hot_rows=hot))
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        q = rng.choice([0, 0, 0, 1, 2, None])
        pick = lambda top: rng.choice([None, float("nan"), float("inf"), round(rng.random() * top, 1), 0.0])
        rows.append((q, f"d{rng.randint(0, 120)}", pick(1e6), pick(1), "x", "y"))
    rows += rows[:30] + [(5, "only", 1.0, None, "", ""), (6, "none", None, float("nan"), "", ""), (7, None, 1.0, 1.0, "", "")]
    got = {(r["query_id"], r["document_id"]): (r["positive"], r["negative"]) for r in net_flow(hits(spark, rows), {"a": 1.0, "b": 1.0}, "query_id", "document_id", scale, 60, *thresholds).collect()}
    want = flows(rows, utility, *thresholds)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_scale_does_not_matter(spark):
    rows = [(0, f"d{i}", float(i), float((i * 7) % 10), "", "") for i in range(10)]
    net = lambda rs: {r["document_id"]: round(r["net"], 9) for r in net_flow(hits(spark, rs), {"a": 2.0, "b": 1.0}).collect()}
    stretched = [(q, d, a**5 * 1e6, b, *x) for q, d, a, b, *x in rows]
    assert net(rows) == net(stretched)


def test_thresholds_change_the_order(spark):
    """One item a little better in the first list, the other much better in the second."""
    a = {"x": 100, "y": 99, **{f"z{i}": i for i in range(18)}}
    b = {"y": 60, "x": 10, **{f"z{i}": i * 3.5 for i in range(18)}}
    rows = [(0, d, float(a[d]), float(b[d]), "", "") for d in a]
    net = lambda **t: {r["document_id"]: r["net"] for r in net_flow(hits(spark, rows), {"a": 17.0, "b": 1.0}, **t).collect()}
    strict, tolerant = net(indifference=0.0, preference=0.01), net(indifference=0.1, preference=0.6)
    assert strict["x"] > strict["y"] and tolerant["x"] < tolerant["y"]


def test_flow_edge_cases(spark):
    none = hits(spark, [])
    assert net_flow(none, {"a": 1.0}).count() == 0 and net_flow(hits(spark, [(1, "d", None, None, "", "")]), {"a": 1.0, "b": 1.0}).count() == 0
    one = net_flow(hits(spark, [(1, "d", 3.0, None, "", "")]), {"a": 1.0, "b": 1.0}).first()
    assert (one["positive"], one["negative"], one["net"], one["items"]) == (0.0, 0.0, 0.0, 1)
    for bad in ({}, {"a": 0.0}):
        with pytest.raises(ValueError):
            net_flow(none, bad)
    with pytest.raises(ValueError):
        net_flow(none, {"a": 1.0}, scale="raw")
    with pytest.raises(ValueError):
        net_flow(none, {"a": 1.0}, indifference=0.5, preference=0.5)


# 7


@pytest.fixture(scope="module")
def encoder():
    return Encoder(serialized_model(read_ranks(default_vocabulary())))


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_every_character(encoder, public):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}  {chr(c)}x" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert encoder(texts).to_pylist() == public(texts)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(encoder, public, text):
    ids = encoder([text]).to_pylist()[0]
    assert ids == public([text])[0]
    tokens = read_ranks(default_vocabulary()) if not hasattr(encoder, "tokens") else encoder.tokens
    encoder.tokens = tokens
    assert b"".join(tokens[i] for i in ids).decode() == text


def test_encoded_table(spark, public):
    texts = [None, "", "<|endoftext|> is text", "it's  100\n\n\tdéjà vu 分布式 🚀", "x" * 20_000, " " * 5000 + "y", "it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    encoded = encode(df)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: (public([t])[0] if t else []) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode(df.where("false")).count() == 0


def test_cache_is_emptied(encoder, public, monkeypatch):
    import findery.llm.tokenizing as module

    monkeypatch.setattr(module, "_CACHE", 3)
    for t in ("one two three four", "five one six", "one"):
        assert encoder([t, t]).to_pylist() == public([t, t])


# 9

CLEAN = [
    "Größere Länge für die Prüfsumme, während der nächtlichen Zusammenführung übersprungen — „fällt“",
    "Où échoue la tâche, l'équipe a déplacé le nœud périmé à côté de la fenêtre prévue, très dégradé",
    "¿Por qué dejó el índice vacío? Según la réplica, la versión omitió términos: día, almacén, él",
    "não há mutações; a réplica não contém ocorrências após a substituição — “ATENÇÃO: CONFIGURAÇÃO”",
    "Сумма показала, что хранилище документов пропустил записей несмотря на повтор после ночной сборки",
    "Если узел вернул ошибку, нужно перезапустить векторный индекс и проверить частоту термина",
    "磁盘变慢时，协调节点跳过了记录。请重启倒排索引并检查平均文档长度，夜间重建之后。",
    "Plain text with “quotes”, 20 °C, 5 µs, £3, € 7 and a naïve café — don’t wait…",
]


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(w for _ in range(3) for w in rng.sample(t.split(), len(t.split()))) for t in (rng.choice(CLEAN) for _ in range(n))]


@pytest.fixture(scope="module")
def model():
    return train(texts_of(1, 400))


def found(model, text):
    return in_text(text, {r: model.judge(r) for r in encoding._RUN.findall(text)})


def test_held_out_accuracy(model):
    clean = texts_of(2, 200)
    assert sum(bool(found(model, t)) for t in clean) == 0
    changed = right = restored = 0
    for t in texts_of(3, 60):
        for chain in CHAINS:
            bad = garble(t, chain)
            same = any(garble(t, ((("utf-8", chain[0][1]),) if chain[0][0] != "utf-8" else (("cp1252", "utf-8"),))) == bad for _ in (0,))
            if bad == t or chain[0][0] not in ("utf-8",) or same:
                continue
            changed += 1
            hit = found(model, bad)
            right += bool(hit)
            if chain[-1][1] != "utf-8" and "�" not in bad:
                back = encoding._RUN.sub(lambda m: hit[m.group()].restored if m.group() in hit and hit[m.group()].restored else m.group(), bad)
                restored += back == t
    assert changed > 300 and right / changed > 0.97 and restored / changed > 0.75


def test_training_where_the_texts_are(spark):
    texts = [*texts_of(5, 150), garble(CLEAN[1], CHAINS[0])]
    there = encoding.train_table(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    here = train(texts)
    assert np.allclose(there.odds, here.odds) and np.allclose(there.clean, here.clean) and there.attested - {"\n"} == here.attested - {"\n"}
    spread = encoding.train_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    assert np.abs(spread.clean - here.clean).mean() < 0.05  # pairs across the ends of runs depend on their order
    assert np.isfinite(encoding.train_table(spark.createDataFrame([], "text string")).odds).all()


def test_evidence_of_one_source_adds_up():
    verdict = lambda chain: encoding.Verdict(chain, "", True, False)
    text = "xабвгx yдежзy"
    one, two = encoding._RUN.findall(text)
    assert set(in_text(text, {one: verdict("cp1251>latin-1"), two: verdict("cp1251>cp1252")})) == {one, two}
    assert in_text(text, {one: verdict("cp1251>latin-1"), two: verdict("koi8-r>cp1252")}) == {}


def test_code_pages_and_lost_text(model):
    russian, chinese, german = CLEAN[4], CLEAN[6], CLEAN[0]
    for t, chain in ((russian, (("koi8-r", "cp1251"),)), (russian, (("cp1251", "latin-1"),)), (chinese, (("gbk", "latin-1"),)), (german, (("cp1252", "utf-8"),))):
        assert found(model, garble(t, chain)), name(chain)
    lost = found(model, garble("Größe", (("cp1252", "utf-8"),)))
    assert all(v.restored is None and not v.whole for v in lost.values())


def test_unusual_but_correct_text(model):
    for t in ("РАЗМЕР ЪЫЭ", russian_capitals := CLEAN[4].upper(), "ÐORP ÞING", "★★★☆☆ ※※※", "ＢＭ２５", "ﬁnal ﬂush", "½ ⅔ √2 ≈ Δt ≤", "אינדקס سجل البحث नोड सूची", "a\xadsoft zero​width", "╔══╗ ├── └──", "ÄÖÜ àà É", "🚀 👩‍💻"):
        assert not found(model, t), t
    assert russian_capitals


def test_inversion_is_strict():
    for chain in CHAINS:
        if chain[0][0] == "utf-8" and len(chain) == 1 and chain[0][1] != "gbk":
            bad = garble("déjà", chain)
            assert invert(bad, chain) == ("déjà", True) or "�" in bad, name(chain)
    assert invert("déjà", (("utf-8", "cp1252"),)) is None
    assert invert("x�", (("cp1252", "utf-8"),)) is None
    assert invert("–Ã©", (("utf-8", "latin-1"),)) == ("–é", False)


def test_wrongly_decoded_table(spark):
    texts = texts_of(4, 300) + [None, "", "ascii only", garble("schöne Prüfsumme für die Größe", CHAINS[0]), "fine " * 30_000 + garble("für", CHAINS[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("chain", F.lit("clash"))
    got = {r["doc_id"]: r for r in wrongly_decoded(df).collect()}
    assert set(got) == {303, 304} and got[303]["restored"] == "schöne Prüfsumme für die Größe" and got[303]["complete"]
    assert got[304]["restored"].endswith("für")
    assert wrongly_decoded(df.where("false")).count() == 0 and wrongly_decoded(df.where("doc_id = 302")).count() == 0


@pytest.mark.parametrize("good", ["10 – 20", "a dağ b", "Ελληνικά"])
def test_characters_that_the_sample_lacks(spark, good):
    """What an inversion gives is judged by all records, and a long whole one proves itself."""
    texts = [t.translate({0x2014: "-", 0x2026: "..."}) for t in texts_of(5, 300)]
    unsampled = [r[0] for r in spark.range(1000, 1100).where("pmod(xxhash64(id), 2) = 1").take(2)]
    late = dict(zip(unsampled, ("a dağ b", f"only {garble(good, CHAINS[0])} here")))
    df = spark.createDataFrame([*enumerate(texts), *late.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["restored"] for r in wrongly_decoded(df, sample_rows=df.count() // 2).collect()}
    assert got == {unsampled[1]: f"only {good} here"}


@pytest.mark.parametrize("chain", [CHAINS[0], CHAINS[1], CHAINS[8]])
def test_garbled_stretch_within_a_chinese_sentence(model, chain):
    before, stretch, after = "磁盘变慢时，协调节点跳过了记录。请重启", "倒排索引", "并检查平均文档长度，夜间重建之后。"
    text = before + garble(stretch, chain) + after
    hit = found(model, text)
    assert encoding._RUN.sub(lambda m: hit[m.group()].restored if m.group() in hit else m.group(), text) == before + stretch + after
    assert not found(model, before + "“" + stretch + "”——……·" + after)
