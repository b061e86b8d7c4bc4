"""Operators on texts against brute force on small tables, and their edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.functions.analysis import terms
from findery.llm import near_duplicates as nd
from findery.llm.distinctiveness import query_terms, record_terms
from findery.llm.frequencies import SuffixArray, intervals, map_frequencies, map_record_count, mark, ngram_frequencies
from findery.llm.leakage import Passages, leaks, myers, myers_many
from findery.llm.near_duplicates import near_duplicates
from findery.llm.splitting import Offsets, cut_texts, pieces

#: Extra columns with names that operators use inside.
SCHEMA = "doc_id bigint, text string, term string, n int, record string, bucket bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None, 7) for i, t in enumerate(texts)], SCHEMA)


def sample(seed, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + [None, "", " \n ", "!!", "Alpha ALPHA alpha", texts[0], texts[0]]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# 1


def counted(records, longest):
    occurrences, within = Counter(), defaultdict(set)
    for i, own in enumerate(records):
        for n in range(1, min(len(own), longest) + 1):
            for at in range(len(own) - n + 1):
                occurrences[tuple(own[at : at + n])] += 1
                within[tuple(own[at : at + n])].add(i)
    return {g: (c, len(within[g])) for g, c in occurrences.items()}


@pytest.mark.parametrize("max_n, block", [(3, 1 << 20), (7, 300), (None, 300)])
def test_ngrams_against_counting(spark, monkeypatch, max_n, block):
    import findery.llm.frequencies as module

    monkeypatch.setattr(module, "BLOCK_TOKENS", block)
    texts = sample(1, 60)
    got = ngram_frequencies(table(spark, texts).repartition(3), max_n=max_n)
    want = counted([terms(t) for t in texts], max_n or 99)
    assert rows(got, "n", "term", "occurrences", "records") == sorted(((len(g), " ".join(g), *c) for g, c in want.items()), key=repr)


def test_suffix_array_against_sorting():
    rng = random.Random(13)
    for _ in range(150):
        records = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        records = records[:4] + records[: rng.randint(0, 2)]
        tokens, lengths = np.array([t for r in records for t in r], np.int64), np.array([len(r) for r in records])
        suffixes = [(r[at:], sum(lengths[:i]) + at) for i, r in enumerate(records) for at in range(len(r))]
        array = SuffixArray(tokens, lengths) if len(tokens) else None
        if array is not None:
            assert array.order.tolist() == [at for _, at in sorted(suffixes)]
            of = {at: s for s, at in suffixes}
            a, b = np.array([(p, q) for p in range(len(tokens)) for q in range(len(tokens)) if p != q], int).reshape(-1, 2).T
            shared = [next((i for i, (x, y) in enumerate(zip(of[p], of[q])) if x != y), min(len(of[p]), len(of[q]))) for p, q in zip(a.tolist(), b.tolist())]
            assert array.common_prefix(a, b, 99).tolist() == shared
        got = {tuple(tokens[p : p + n].tolist()): (c, r) for n, at, count, recs in intervals(tokens, lengths) for p, c, r in zip(at.tolist(), count.tolist(), recs.tolist())}
        assert got == counted(records, 99)


def test_ngrams_edge_cases(spark):
    assert ngram_frequencies(table(spark, [])).count() == 0
    assert ngram_frequencies(table(spark, [None, "", "..."]), max_n=2).count() == 0
    long = "word " * 50_000
    assert rows(ngram_frequencies(table(spark, [long] * 3)), "term", "occurrences", "records") == [("word", 150_000, 3)]
    with pytest.raises(ValueError):
        ngram_frequencies(table(spark, ["a"]), max_n=0)
    assert list(intervals(np.empty(0, np.int64), np.empty(0, np.int64), 2)) == list(intervals(np.empty(0, np.int64), np.zeros(3, np.int64))) == []


def test_map_counts(spark):
    schema = "shard_id int, generation bigint, document_count bigint, document_frequencies map<string, bigint>, term string"
    answers = [(0, 1, 10, {"a": 5}, ""), (0, 2, 11, {"a": None, "b": 1}, ""), (0, 2, 11, {"a": None, "b": 1}, ""), (1, 1, 7, None, ""), (1, None, 99, {"a": 9}, ""), (2, 3, None, {"a": 1, "z": 0}, "")]
    df = spark.createDataFrame(answers, schema)
    assert rows(map_frequencies(df), "term", "records") == [("a", 6), ("b", 1), ("z", 0)]
    assert map_record_count(df).first()[0] == 18
    none = df.where("false")
    assert map_frequencies(none).count() == 0 and map_record_count(none).first()[0] == 0
    marks = spark.createDataFrame([(2, 5), (3, 10), (3, 20), (1, 1)], "r bigint, t bigint")
    assert [r[0] for r in marks.select(mark(F.col("r"), F.col("t"))).collect()] == ["rare", "common", None, "rare"]


# 2


@pytest.mark.parametrize("share", [1000, 4])
def test_distinctive_terms(spark, monkeypatch, share):
    import findery.llm.distinctiveness as d

    monkeypatch.setattr(d, "HEAD_SHARE", share)
    texts = sample(2) + [f"name{i} name{i} alpha rare{i % 7}" for i in range(40)]
    counts = [Counter(terms(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    n = sum(t is not None for t in texts)
    want = []
    for i, c in enumerate(counts):
        scored = sorted((-round(f * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)), 9), t) for t, f in c.items())
        want += [(i, t, c[t], df[t], place + 1) for place, (_, t) in enumerate(scored[:3])]
    got = record_terms(table(spark, texts).repartition(3))
    assert rows(got, "doc_id", "term", "tf", "df", "place") == sorted(want, key=repr)
    one = got.where("doc_id = 0").first()
    assert one["weight"] == pytest.approx(one["score"] / len(terms(texts[0])), abs=1e-8)


def test_distinctive_terms_bounded_head(spark, monkeypatch):
    import findery.llm.distinctiveness as d

    texts = sample(3)
    want = rows(record_terms(table(spark, texts)))
    monkeypatch.setattr(d, "HEAD_ROWS", 3)
    monkeypatch.setattr(d, "HEAD_SHARE", 50)
    assert rows(record_terms(table(spark, texts))) == want


def test_distinctive_edge_cases(spark):
    assert record_terms(table(spark, [])).count() == 0
    assert record_terms(table(spark, [None, "", "?"])).count() == 0
    assert rows(record_terms(table(spark, ["b a", "a b"])), "doc_id", "term") == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]


def test_query_terms(spark):
    answers = spark.createDataFrame(
        [
            (1, 0, 1, 50, {"a": 9, "b": 1}), (1, 0, 2, 60, {"a": 10, "b": 2, "q": 0}), (1, 0, 2, 60, {"a": 10, "b": 2, "q": 0}), (1, 1, 5, 40, {"a": None, "b": 1}), (1, 1, 9, 44, None),
            (2, 0, 1, 5, {"a": 1}), (3, 0, 1, 5, {"zz": 1}), (None, 0, 1, 5, {"a": 1}),
        ],
        "query_id bigint, shard_id int, generation bigint, document_count bigint, document_frequencies map<string, bigint>",
    ).withColumn("collected_at", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([(1, "A b a q"), (2, None), (3, "a")], "query_id bigint, query string")
    got = query_terms(answers, queries, k=2).orderBy("place").collect()
    assert [(r["query_id"], r["term"], r["tf"], r["df"]) for r in got] == [(1, "a", 2, 10), (1, "b", 1, 3)]
    assert got[0]["score"] == round(2 * math.log(1 + (100 - 10 + 0.5) / 10.5), 9)
    assert query_terms(answers.where("false"), queries).count() == 0


# 3


def edited(seed, n, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            texts.append(" ".join(other))
    return texts


def similar(texts, width, similarity, least):
    sets = {i: {tuple(t[j : j + width]) for j in range(len(t) - width + 1)} for i, x in enumerate(texts) if len(t := terms(x)) >= max(least, width)}
    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    candidates = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    return {(a, b) for a, b in candidates if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


def test_near_duplicates_against_all_pairs(spark):
    texts = edited(4, 150, 5) + [None, "", "too short"]
    want = similar(texts, 3, 0.7, 20)
    got = near_duplicates(table(spark, texts).repartition(4), shingle=3, similarity=0.7, min_terms=20).record_pairs("doc_id")
    found = rows(got)
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(want - set(found)) <= 0.002 * len(want) and len(want) > 200


def test_near_duplicates_split_hot_buckets(spark, monkeypatch):
    texts = edited(5, 6, 40)
    want = similar(texts, 3, 0.7, 20)
    monkeypatch.setattr(nd, "HOT", 5)
    found = set(rows(near_duplicates(table(spark, texts), shingle=3, similarity=0.7, min_terms=20).record_pairs("doc_id")))
    assert found <= want and len(want - found) <= 0.01 * len(want)


def test_near_duplicates_by_shuffle(spark, monkeypatch):
    texts = edited(6, 40, 3)
    want = rows(near_duplicates(table(spark, texts)).pairs.select("class_a", "class_b"))
    monkeypatch.setattr(nd, "BROADCAST_KEYS", 0)
    assert rows(near_duplicates(table(spark, texts)).pairs.select("class_a", "class_b")) == want


def test_texts_are_not_shuffled(spark, monkeypatch):
    """However many records are candidates, their sets are made where the texts are."""
    monkeypatch.setattr(nd, "BROADCAST_KEYS", 0)
    plan = near_duplicates(table(spark, edited(6, 40, 3))).pairs._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("shingles") :]
    assert "MapInArrow" in below and "LeftSemi" not in below


def test_symbols_shared_by_chance_make_no_candidates(spark):
    """Records that share three symbols, and with them a key, and no others: they grow as the square of the records."""
    symbols = np.random.default_rng(3).integers(0, 2**32, (190, nd.SYMBOLS), dtype=np.uint32)
    symbols[:, :3] = 7
    near = symbols[:1].copy()
    near[0, [3, *range(17, 31)]] += 1  # as far as is found for certain
    symbols = np.concatenate([symbols, near])
    sketches = [nd.packed(symbols, at).tolist() for at in range(2)]
    first = spark.createDataFrame([(i, *(s[i] for s in sketches), symbols[i].view(np.int32).tolist()) for i in range(len(symbols))], "record bigint, sketch bigint, second bigint, symbols array<int>")
    assert nd.keys_for(0.7).distance == 15 and rows(nd._candidates(first, 0.7)) == [(0, 190)]


def test_groups_and_classes(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b, c = a + " x1 x2", a + " x1 x2 x3 x4 x5"
    other = " ".join(f"v{i}" for i in range(60))
    texts = [a, b, c, other, a, a.upper(), None, other + "!", "short text"]
    got = {r["doc_id"]: (r["class_id"], r["group_id"], r["links"]) for r in near_duplicates(table(spark, texts)).groups("doc_id").collect()}
    assert got[0] == got[4] == got[5] == (0, 0, 2) and got[2][1] == 0 and got[3] == got[7] == (3, 3, 0)
    assert set(got) == {0, 1, 2, 3, 4, 5, 7}
    pairs = rows(near_duplicates(table(spark, texts)).record_pairs("doc_id"))
    assert (0, 4) in pairs and (3, 7) in pairs and (4, 5) in pairs and (0, 3) not in pairs


def test_every_record_has_a_group(spark):
    a = " ".join(f"w{i}" for i in range(60))
    texts = ["Short text", a, None, "", "short  TEXT!", a + " x1", " \n", None, "!!", "one two three four", a]
    got = {r["doc_id"]: (r["class_id"], r["group_id"], r["links"]) for r in near_duplicates(table(spark, texts)).groups("doc_id", every=True).collect()}
    assert got == {0: (0, 0, 0), 4: (0, 0, 0), 1: (1, 1, 1), 10: (1, 1, 1), 5: (5, 1, 1), **{i: (i, i, 0) for i in (2, 7, 9)}, **{i: (3, 3, 0) for i in (3, 6, 8)}}


def test_copies_are_one_class(spark):
    """A third of all rows is one text; it takes part once."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [base] * 400 + edited(7, 150, 2)
    result = near_duplicates(table(spark, texts))
    sizes = {r["class_id"]: r["count"] for r in result.members.groupBy("class_id").count().collect()}
    assert sizes[0] == 400
    assert result.pairs.where("class_a = 0 or class_b = 0").count() == 0


def test_chains_connect(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "v bigint, w bigint")
    assert {r["v"]: r["label"] for r in nd.connected(df).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_near_duplicates_edge_cases(spark):
    empty = near_duplicates(table(spark, []))
    assert empty.members.count() == 0 and empty.record_pairs("doc_id").count() == 0 and empty.groups("doc_id").count() == 0
    assert near_duplicates(table(spark, [None, "", "one two"])).record_pairs("doc_id").count() == 0


@pytest.mark.parametrize("shape", nd.SHAPES)
def test_every_pair_within_the_distance_shares_a_key(shape):
    rng = random.Random(11)
    for _ in range(2000):
        differ = set(rng.sample(range(nd.SYMBOLS), rng.randint(0, shape.distance)))
        assert any(differ.isdisjoint(k) for k in shape.chosen)


def test_keys_follow_the_similarity():
    for similarity in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 1.0):
        shape = nd.keys_for(similarity)
        assert shape.chunks * shape.width == nd.SYMBOLS and shape.reach(similarity) > 0.997
    assert nd.keys_for(0.97).chunks == 4 and nd.keys_for(0.7) == nd.keys_for(0.8) == nd.Keys(8, 4, 1) and nd.keys_for(0.5).errors == 2
    for bad in (0.3, 0.0, 1.1):
        with pytest.raises(ValueError):
            nd.keys_for(bad)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8])
def test_recall_at_other_similarities(spark, similarity):
    rng = random.Random(12)
    texts = []
    for at in range(400):  # pairs at and just above the threshold
        base = [f"w{rng.randrange(5000)}" for _ in range(80)]
        texts += [" ".join(base), " ".join(base[: int(80 * (similarity + rng.uniform(0, 0.05)))] + [f"x{at}y{i}" for i in range(rng.randint(0, 12))])]
    want = similar(texts, 2, similarity, 0)
    found = set(rows(near_duplicates(table(spark, texts), shingle=2, similarity=similarity).record_pairs("doc_id")))
    assert found <= want and len(want) > 50 and len(found) >= 0.99 * len(want)


def test_large_classes_are_spread(spark, monkeypatch):
    a = " ".join(f"w{i}" for i in range(60))
    texts = [a, a + " x1", *[a] * 12, *[a + " X1"] * 9]
    want = rows(near_duplicates(table(spark, texts)).record_pairs("doc_id"))
    monkeypatch.setattr(nd, "BLOCK", 4)
    assert rows(near_duplicates(table(spark, texts)).record_pairs("doc_id")) == want == sorted(((i, j) for i in range(23) for j in range(i + 1, 23)), key=repr)


def test_packed_symbols_fit():
    symbols = np.random.default_rng(0).integers(0, 2**32, (50, nd.SYMBOLS), dtype=np.uint32)
    assert nd.packed(symbols).dtype == np.int64 and len(set(nd.packed(symbols).tolist())) == 50
    assert nd.farthest(1.0) == 0 and nd.farthest(0.0) <= nd.SYMBOLS


# 5


BLANKS = "\t\n\r  　"


def check_pieces(text, limit, overlap):
    cuts = list(Offsets(text).cuts(limit, overlap))
    covered = np.zeros(len(text), bool)
    for (s, e, _), before in zip(cuts, [None, *cuts]):
        piece = text[s:e]
        assert 0 < len(piece) <= limit and piece == piece.strip(BLANKS)
        covered[s:e] = True
        if before:
            assert s <= e and e > before[1] and s >= before[1] - overlap
    assert all(c in BLANKS for c, seen in zip(text, covered) if not seen)
    return cuts


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = [rng.choice(["word", "a", "x" * rng.randint(1, 90), ". ", "! ", "。", "？", " ", "\n", "\r\n", "\n \n", " ", "　", ".", "\t"]) for _ in range(rng.randint(0, 250))]
        check_pieces("".join(parts), rng.randint(1, 120), 0)
        limit = rng.randint(2, 120)
        check_pieces("".join(parts), limit, rng.randrange(limit))


def test_boundaries():
    line = "w" * 9 + " "
    assert Offsets("a b\n\n" + "c d").boundary(5) == "paragraph"
    assert Offsets("aaa\nbbb\nccc").boundary(5) == "line"
    assert Offsets("One two. Three four. Five").boundary(12) == "sentence"
    assert Offsets("一二。三四。").boundary(3) == "sentence"
    assert Offsets("e.g.x " + line * 3).boundary(10) == "word"
    assert Offsets("x" * 30).boundary(10) == "hard"
    assert Offsets(" \n ").boundary(2) == "paragraph"
    assert Offsets("a.b.c.d e").boundary(4) == "hard" and Offsets("ab. cd. e").boundary(3) == "sentence"


def test_cuts_prefer_coarse_ends_and_overlap():
    text = "First part here.\n\nSecond part is here. And more of it, quite long.\nThird line."
    kinds = [k for _, _, k in check_pieces(text, 40, 10)]
    assert kinds[0] == "paragraph" and "hard" not in kinds
    words = " ".join(f"w{i:03d}" for i in range(200))
    cuts = check_pieces(words, 50, 12)
    assert all(b[0] < a[1] for a, b in zip(cuts, cuts[1:]))  # they overlap
    hard = check_pieces("x" * 100, 30, 10)
    assert [(s, e) for s, e, _ in hard][:3] == [(0, 30), (20, 50), (40, 70)]


def test_cut_tables(spark):
    texts = [None, "", "short", "word " * 900, "word " * 900, "x" * 250_000, "𝔘" * 2001, " " * 3000]
    cut = cut_texts(table(spark, texts))
    assert rows(cut.select("doc_id", "boundary", F.size("cuts"))) == [(3, "word", 3), (4, "word", 3), (5, "hard", 132), (6, "hard", 2), (7, "paragraph", 0)]
    every = pieces(table(spark, texts)).collect()
    assert [(r["doc_id"], r["piece"]) for r in every] == [(i, n) for i, size in ((3, 3), (4, 3), (5, 132), (6, 2)) for n in range(size)]
    for r in every:
        assert r["text"] == texts[r["doc_id"]][r["start"] : r["end"]] and len(r["text"]) <= 2000
    assert cut_texts(table(spark, [])).count() == 0 and pieces(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        cut_texts(table(spark, []), limit=10, overlap=10)


# 8


def distance(a, b):
    """Least edits between a and any stretch of b, by the full table."""
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return min(before)


def test_myers():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert myers(a, b) == distance(a, b)
    for m in (1, 5, 12, 63, 64):
        a, b = (np.array([[rng.randrange(1, 4) for _ in range(n)] for _ in range(60)], np.uint64) for n in (m, m + 4))
        assert myers_many(a, b).tolist() == [distance(x, y) for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_against_all_passages(spark, errors):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(300)]
    items = [[rng.choice(words) for _ in range(rng.randint(6, 30))] for _ in range(25)]
    texts = []
    for _ in range(80):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            it = list(rng.choice(items))
            for _ in range(rng.randint(0, 3)):
                it[rng.randrange(len(it))] = rng.choice(words)
            own += it[rng.randint(0, 5) :] + [rng.choice(words)]
        texts.append(" ".join(own))
    table_items = spark.createDataFrame([(900 + i, " ".join(t).upper(), "x") for i, t in enumerate(items)] + [(1, None, "x"), (2, "", "x")], "item_id bigint, text string, doc_id string")
    want = set()
    for i, x in enumerate(texts):
        own = terms(x)
        for k, it in enumerate(items):
            d = min((distance(it[s : s + 12], own) for s in range(len(it) - 11)), default=99)
            if d <= errors:
                want.add((i, 900 + k, d))
    got = leaks(table(spark, texts + [None, ""]), table_items, errors=errors)
    assert set(rows(got)) == want and len(want) > 10


def test_leaks_edge_cases(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l")], "item_id bigint, text string")
    texts = ["x " * 30_000 + "A, b; c d e f g h i j k l", "a b c d e f g h i j k", None]
    # a text one term short of the passage is one edit from it
    assert rows(leaks(table(spark, texts), items)) == [(0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 2, 1)]
    assert rows(leaks(table(spark, texts), items, errors=0)) == [(0, 1, 0), (0, 2, 0)]
    assert leaks(table(spark, []), items).count() == 0 and leaks(table(spark, texts), items.where("false")).count() == 0
    with pytest.raises(ValueError):
        leaks(table(spark, texts), items, window=2, errors=2)


def test_pieces_without_a_passage_are_no_leak():
    """Texts of which some have a piece of a passage, and none has a passage."""
    passages = Passages([(1, "a b c d e f g h i j k l")], 12, 1, 12)
    cache = nd.TermHashes()
    texts = [np.array([cache[t] for t in own.split()], np.uint64) for own in ("a b c d e f x y z u v w", "x g h i j k l", "")]
    assert [len(x) for x in passages.found(texts)] == [0, 0, 0]


def test_leaks_in_blocks(spark, monkeypatch):
    import findery.llm.leakage as module

    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(9)], "item_id bigint, text string")
    texts = [" ".join(f"w{i}x{j}" for j in range(1, 14)) for i in range(9)]
    want = rows(leaks(table(spark, texts), items))
    monkeypatch.setattr(module, "BLOCK_CHARACTERS", 150)
    monkeypatch.setattr(module, "_CANDIDATES", 3)
    assert rows(leaks(table(spark, texts), items)) == want == [(i, i, 0) for i in range(9)]


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four"), (3, "five six seven eight nine ten")], "item_id int, text string")
    texts = ["x One, two three four five six seven", "one two three four", "one two three x four five six seven eight nine ten", None]
    assert rows(leaks(table(spark, texts), items, least=5)) == [(0, 1, 0), (2, 3, 0)]
    assert leaks(table(spark, texts), items).count() == 0
    with pytest.raises(ValueError):
        leaks(table(spark, texts), items, least=13)


def test_many_items_share_a_template():
    """10,000 items with one beginning: each passage of the template is one, and text with it names every item."""
    template = [f"t{i}" for i in range(20)]
    passages = Passages([(i, " ".join([*template, *(f"u{i}x{j}" for j in range(10))])) for i in range(10_000)], 12, 1, 12)
    (of,) = passages.classes
    assert len(of.starts) == 9 + 10_000 * 10
    cache = nd.TermHashes()
    texts = [np.array([cache[t] for t in own], np.uint64) for own in (template, [*template[14:], *(f"u7x{j}" for j in range(5)), "other", "u7x6"], ["a", "b"])]
    text, item, distance = passages.found(texts)
    assert (text == 0).sum() == 10_000 and set(distance[text == 0]) == {0}
    assert [(passages.keys[i], d) for i, d in zip(item[text == 1], distance[text == 1])] == [(7, 1)] and not (text == 2).any()
