import itertools
import re

import pytest
from pyspark.sql import functions as F

from engram.functions import scoring
from engram.functions.text import content_words, fuzzy_words, glob_regex, has_all_words, keyword_score, preview
from engram.operators import audit, chunking, graph, integrity, relations, search, similarity
from engram.sources import store


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_words_and_scores(spark):
    df = spark.createDataFrame([(1, "The retention job ran. Job done"), (2, "retentions jobs"), (3, ""), (4, None), (5, "été — Ünlü_1")], "id int, text string")
    got = {r.id: r for r in df.select("id", has_all_words(F.col("text"), "Retention job").alias("all"), keyword_score(F.col("text"), "retention job").alias("s"), content_words(F.col("text")).alias("w"), fuzzy_words(F.col("text"), "retentio jib").alias("f")).collect()}
    assert [got[k]["all"] for k in range(1, 6)] == [True, True, False, None, False]
    assert got[1].s == pytest.approx(min(1, 3 / 6 * 1.5)) and got[2].s == 0 and got[3].s is None and got[4].s is None
    assert got[1].w == ["retention", "job", "ran", "done"] and got[5].w == ["été", "ünlü_1"]
    assert [got[k].f for k in range(1, 6)] == [True, False, False, None, False]


def test_globs_and_previews(spark):
    assert re.match(glob_regex("memory:*:1?"), "memory:document:12") and not re.match(glob_regex("a.c"), "abc")
    got = spark.createDataFrame([("x" * 101,), ("short",), (None,)], "t string").select(preview(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["x" * 100 + "...", "short", None]


def test_scores(spark):
    df = spark.createDataFrame([(0.75, 3600.0, 9), (0.4, 86401.0, 0), (0.1, 1e9, None)], "s double, age double, n int")
    got = df.select(scoring.tier(F.col("s")).alias("t"), scoring.temporal_boost(F.col("age")).alias("b"), F.round(scoring.access_frequency(F.col("n")), 3).alias("a"), scoring.ttl_days(F.col("s"), F.lit(0.6), F.lit(0.4), F.lit(None).cast("double")).alias("d")).collect()
    assert [(r.t, r.b) for r in got] == [("hot", 0.3), ("warm", 0.1), ("archive", 0.0)]
    assert [r.a for r in got] == [0.5, 0.0, 0.0]
    assert [r.d for r in got] == [711, 175, 13]
    parts = [F.lit(1.0), F.lit(None).cast("double")]
    assert spark.range(1).select(scoring.weighted(parts, (0.2, 0.8)).alias("w")).first().w == 1.0


EDGES = [("a", "b", 0.9), ("b", "a", 0.8), ("b", "c", 0.7), ("a", "c", 1.0), ("c", "d", 0.95), ("x", "y", 0.8), ("p", "q", 0.1), (None, "q", 0.9), ("z", "z", 1.0), ("n", "m", float("nan")), ("n", "m", None)]


def test_graph(spark):
    pairs = graph.undirected(spark.createDataFrame(EDGES, "s string, t string, w double"), "s", "t", "w", 0.7)
    assert values(pairs, "a", "b", "weight") == [("a", "b", 0.9), ("a", "c", 1.0), ("b", "c", 0.7), ("c", "d", 0.95), ("x", "y", 0.8)]
    assert values(graph.clustering(pairs), "node", "degree", "triangles", "coefficient")[:4] == [("a", 2, 1, 1.0), ("b", 2, 1, 1.0), ("c", 3, 1, 1 / 3), ("d", 1, 0, 0.0)]
    assert values(graph.lone_pairs(pairs), "node", "neighbour") == [("x", "y"), ("y", "x")]
    assert values(graph.density(pairs), "nodes", "edges") == [(6, 5)]
    ways = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    got = values(graph.expand(spark.createDataFrame([("d",)], "node string"), ways), "node", "step")
    assert got == [("a", 2), ("c", 1), ("d", 0)]
    empty = graph.undirected(spark.createDataFrame([], "s string, t string, w double"), "s", "t", "w", 0.7)
    assert graph.clustering(empty).count() == 0 and graph.density(empty).first().density == 0


def test_trailing_counts_against_brute_force(spark):
    rows = [(k, "u" if k % 3 else None, (k * k * 37) % 5000) for k in range(300)]
    got = values(audit.trailing_counts(spark.createDataFrame(rows, "id int, p string, us long"), ["p"], "us", 100), "id", "n")
    assert got == sorted(((i, sum(q == p and 0 <= t - v <= 100 for _, q, v in rows)) for i, p, t in rows), key=str)


def test_anomalies_at_the_threshold(spark):
    rows = [(f"e{k}", "u", 60_000_000 * k, "login_failed") for k in range(6)] + [("other", "v", 0, "login_failed"), ("late", None, None, "login_failed")]
    got = values(audit.anomalies(spark.createDataFrame(rows, "id string, p string, us long, kind string"), "id", "p", "us", F.col("kind")), "id", "pattern", "n")
    assert got == [("e4", "brute_force", 5), ("e5", "brute_force", 6)]


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_similar_pairs_against_brute_force(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base + ["more"]), " ".join(reversed(base)), "one two", "One, two!", "", None, "  ", " ".join(base[:50])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, "id", "text").collect()}
    want = {}
    for (i, s), (j, t) in itertools.combinations([(i, t) for i, t in enumerate(texts) if t], 2):
        x, y = shingles(s), shingles(t)
        if x and y and len(x & y) / len(x | y) >= 0.8:
            want[i, j] = len(x & y) / len(x | y)
    assert got == pytest.approx(want) and len(want) >= 4


def test_equal_texts(spark):
    df = spark.createDataFrame([(1, "a", 10, "s"), (2, "a", 20, "t"), (3, "b", 5, None), (4, None, 1, "s"), (5, "a", None, "s")], "id int, text string, at int, label string")
    assert values(similarity.exact_groups(df, "id", "text"), "id", "class_id", "members") == [(1, 1, 3), (2, 1, 3), (3, 3, 1), (5, 1, 3)]
    assert values(similarity.merged(df, "id", "text", "at", "label"), "newest", "oldest", "members", "labels") == [(2, 5, 3, "s; t")]


TEXT = "# Title\nIntro one. Intro two!\n\n## Part\n```\n# no heading\n```\nBody here? Yes.\n\n" + "Long sentence number one. " * 60


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_chunks_cover_the_text(strategy):
    cut = chunking.STRATEGIES[strategy]
    parts = cut(TEXT)
    assert all(TEXT[a:b].strip() and a < b for a, b, _ in parts) and parts[0][0] == 0
    assert "".join(TEXT[a:b] for a, b, _ in parts).replace(" ", "").replace("\n", "").find("Longsentence") > 0
    covered = set(itertools.chain.from_iterable(range(a, b) for a, b, _ in parts))
    assert not TEXT.encode() or all(c.isspace() or k in covered for k, c in enumerate(TEXT))
    assert cut("") == []


def test_chunk_sections_and_tables(spark):
    assert [k for *_, k in chunking.sections(TEXT)] == ["section_1", "section_2"]
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "   ")], "id int, text string")
    assert {r.id for r in chunking.chunk(df, "id", "text", "fixed").collect()} == {1}


def test_relations(spark):
    chats = spark.createDataFrame([(1, "assistant: hi\nuser: a: b\nuser: c\nassistant: d\nnoise\nuser: e"), (2, None), (3, "")], "id int, text string")
    said = relations.messages(chats, "id", "text")
    assert values(said, "turn", "role", "content")[1] == (1, "user", "a: b")
    assert values(relations.chat_sessions(said, "id"), "session", "first_turn", "messages") == [(1, 1, 3), (2, 5, 1)]
    named = spark.createDataFrame([("x", "see memory:insight:4, memory:insight:4 (memory:state:9)"), ("y", None)], "id string, t string")
    assert values(relations.references(named, "id", "t"), "ref", "n") == [("memory:insight:4", 2), ("memory:state:9", 1)]


def test_integrity(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, t string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "id int, t string")
    assert values(integrity.differences(left, right, "id", "t"), "id", "status") == [(1, "match"), (2, "mismatch"), (3, "match"), (4, "extra")]
    assert values(integrity.differences(right, left, "id", "t"), "id", "status")[3] == (4, "missing")
    found = integrity.sensitivity(spark.createDataFrame([("mail a@b.example, 123-45-6789",), ("the API_KEY",), ("plain",)], "t string"), "t").collect()
    assert [(r.pii, r.level) for r in found] == [("email,ssn", "pii"), ("", "confidential"), ("", "public")]
    broken = integrity.broken_rules(left, "id", {"given": (F.col("t") != "", "error")})
    assert values(broken, "id", "rule") == [(3, "given")]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert values(store.upsert(old, new, ["k"]), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    stay, gone = store.delete(old, "k", "a*")
    assert values(stay, "k") == [("b",)] and values(gone, "k") == [("a",)]
    assert values(store.newest(old.unionByName(spark.createDataFrame([("a", 0)], "k string, v int")), ["k"], ["v"]), "k", "v") == [("a", 1), ("b", 2)]
    path = str(tmp_path / "t")
    for df in (old, new):
        store.publish(df, path)
        assert values(spark.read.parquet(path), "k", "v") == values(df, "k", "v")


def test_neighbours_in_time(spark):
    rows = [(1, 0), (2, 100), (3, 200), (4, 301), (5, None), (6, 301)]
    got = values(search.neighbours_in_time(spark.createDataFrame(rows, "id int, us long"), "id", "us", 100), "id", "before")
    assert got == [(2, 1), (3, 2), (6, 4)]
