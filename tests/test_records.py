import datetime

from pyspark.sql import functions as F

from engram.functions import paths
from engram.operators import merging, sections


def values(spark, texts, make):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.v for r in df.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]


def test_kinds_of_records(spark):
    said = ['{"message":"Hello","role":"user"}', '{"conversation":"chat_id"}', '{"checkpoint":"v1","data":{}}', '{"state":"running","progress":0.5}', '{"metric":"cpu_usage","value":0.8}', '{"stats":{"count":100},"system":"monitoring"}', '{"title":"Document","body":"Content"}', "plain string", "", "[1]", '{"state":1,"role":2}', None]
    assert values(spark, said, paths.kind_of) == ["conversation"] * 2 + ["state"] * 2 + ["system"] * 2 + ["document"] * 4 + ["conversation", None]


def test_time_paths(spark):
    read = values(spark, ["2024-01-15/14:30:45.123", "2024-01-15/14:30:45/conversation/x", "2024-02-30/10:00:00", "2024-01-15/24:00:00", "2024/01/15", "x2024-01-15/14:30:45", "", None], paths.read_time_path)
    assert (read[0].day, read[0].category, read[0].has_ms) == (datetime.date(2024, 1, 15), None, True) and read[0].at_us % 60_000_000 == 45_123_000
    assert (read[1].category, read[1].has_ms) == ("conversation/x", False) and read[2:] == [None] * 6
    assert values(spark, ["2024-01-15", "2024/01/15", None], paths.is_date) == [True, False, None]
    assert values(spark, ["14:30:45.123", "14:30", "14:30:45"], paths.is_time) == [True, False, True]


def test_references(spark):
    found = values(spark, ["see file \"a.pdf\" as mentioned above", "nothing", "", None], paths.references)
    assert {(r.kind, r.confidence) for r in found[0]} == {("explicit", 0.85), ("explicit", 0.95), ("implicit", 0.65)} and found[1] == [] == found[2] and not found[3]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def records(spark, given):
    return spark.createDataFrame([(*r, "x") for r in given], "id string, memory string, us long, a string, b string, risk double, field string")


GIVEN = [("1", "m", 10, "old", "same", 0.9), ("2", "m", 20, None, "same", 0.1), ("3", "m", 20, "new", None, None), ("4", "n", 5, None, None, None), (None, "m", 1, "q", "q", 1.0), ("5", None, 1, "q", "q", 1.0), ("6", "m", None, "q", "q", 1.0)]


def test_merges(spark):
    df = records(spark, GIVEN)
    facts = merging.facts(df, "id", "memory", "us", ["a", "b"])
    assert facts.count() == 8
    assert rows(merging.newest_values(facts)) == [("m", "a", "new"), ("m", "b", "same")]
    assert rows(merging.all_values(facts)) == [("m", "a", "new", 1, 20), ("m", "a", "old", 1, 10), ("m", "b", "same", 2, 10)]
    best = merging.primaries(df, "id", "memory", "us", "risk", 86_400_000_000 * 730)
    assert rows(best.select("memory", "id")) == [("m", "1"), ("n", "4")]
    assert rows(merging.additions(facts, best)) == [("m", "a", "new", 1)]
    assert rows(merging.summaries(df, "id", "memory", "us").select("memory", "children", "first_child", "last_child")) == [("m", 3, "1", "3"), ("n", 1, "4", "4")]
    none = merging.facts(df.limit(0), "id", "memory", "us", ["a", "b"])
    assert rows(merging.newest_values(none)) == rows(merging.additions(none, best)) == []


def test_primary_by_recency_and_ties(spark):
    year, day = 365 * 86_400_000_000, 86_400_000_000
    df = records(spark, [("old", "m", 0, "", "", 0.5), ("new", "m", year - day, "", "", 0.5), ("b", "t", 0, "", "", None), ("a", "t", 0, "", "", 0.5)])
    assert rows(merging.primaries(df, "id", "memory", "us", "risk", year).select("memory", "id")) == [("m", "new"), ("t", "a")]


def test_strategies(spark):
    said = [("d", "duplicate"), ("d", "duplicate"), ("t", "duplicate"), ("t", "temporal"), ("t", "complement"), ("c", "complement"), ("c", "similar"), ("s", "similar"), ("s", "duplicate")]
    got = merging.strategies(spark.createDataFrame(said, "a string, relation string"), "a", "relation")
    assert rows(got) == [("c", 2, "combine"), ("d", 2, "keep_newest"), ("s", 2, "importance"), ("t", 3, "hierarchical")]


def test_differences_and_patches(spark):
    left = spark.createDataFrame([("1", "a", "x"), ("1", "b", None), ("1", "c", "y"), ("2", "a", "x")], "id string, field string, value string")
    right = spark.createDataFrame([("1", "a", "z"), ("1", "b", None), ("1", "d", "y"), ("3", "a", "x")], "id string, field string, value string")
    assert rows(merging.differences(left, right)) == [("1", "a", "value"), ("1", "c", "missing"), ("1", "d", "extra")]
    df = spark.createDataFrame([("1", {"a": "x", "b": "y", "n": None}, 1), ("2", None, 1), ("3", {"a": "x"}, 1)], "id string, m map<string,string>, patch2 int")
    patch = spark.createDataFrame([("1", {"a": None, "b": "z", "c": "w"}), ("2", {"c": "w"})], "id string, patch map<string,string>")
    assert {r.id: r.m for r in merging.patched(df, patch, "id", "m").collect()} == {"1": {"b": "z", "c": "w", "n": None}, "2": {"c": "w"}, "3": {"a": "x"}}


def test_logs(spark):
    df = spark.createDataFrame([("l", 5_000, "b"), ("l", 5_001, "a"), ("l", 5_001, "c"), ("l", 6_000, "d"), ("o", 5_000, "e"), (None, 1, "f"), ("l", None, "g")], "log string, us long, id string")
    got = merging.log_entries(df, "log", "us", "id")
    assert rows(got) == [("l", "5-0", "b"), ("l", "5-1", "a"), ("l", "5-2", "c"), ("l", "6-0", "d"), ("o", "5-0", "e")]
    assert values(spark, ["5-0", "x", "5", None], merging.entry_millis) == [5, None, None, None]


def test_parts_of_texts(spark):
    text = "intro\n# One\ntext\n### Deep\nmore\n## Two\n```py\nx = 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n# Last"
    df = spark.createDataFrame([(1, text, "t"), (2, None, "t"), (3, "", "t"), (4, "no heading", "t"), (5, "```\nopen", "t")], "doc long, body string, title string")
    got = {r.title: (r.start, r.end, r.level) for r in sections.sections(df, "doc", "body").collect()}
    at = text.index
    assert got == {"One": (at("# One"), at("# Last"), 1), "Deep": (at("### Deep"), at("## Two"), 3), "Two": (at("## Two"), at("# Last"), 2), "Last": (at("# Last"), len(text), 1)}
    where = spark.createDataFrame([(1, 0), (1, at("more")), (1, at("x = 1")), (1, len(text) - 1), (1, len(text)), (9, 1)], "doc long, pos int")
    found = sections.deepest(sections.sections(df, "doc", "body"), where, "doc", "pos")
    assert rows(found.select("pos", "title")) == sorted([(at("more"), "Deep"), (at("x = 1"), "Two"), (len(text) - 1, "Last")], key=str)
    assert rows(sections.code_blocks(df, "doc", "body")) == [(1, 0, "py", "x = 1\n")]
    assert rows(sections.tables(df, "doc", "body")) == [(1, 9, 3, 2)]


def test_surroundings(spark):
    df = spark.createDataFrame([("a", 1, 0, "x" * 150 + " end "), ("b", 1, 10, None), ("c", 1, 20, " begin" + "y" * 200), ("d", None, 0, "q")], "id string, doc long, start int, content string")
    got = {r.id: (r.before, r.behind) for r in sections.surroundings(df, "doc", "start", "id", "content").collect()}
    assert got == {"a": (None, None), "b": ("x" * 95 + " end", "begin" + "y" * 94), "c": (None, None)}


def test_keys_names_and_classes(spark):
    df = spark.createDataFrame([("2025-01-02", "09:10:11.123", "a"), ("x", None, "a"), ("2025-01-02", "20:10:11", None)], "d string, t string, p string")
    made = df.select(paths.key_of(F.lit("document"), F.col("d"), F.col("t"), F.col("p")).alias("k"))
    assert [r.k for r in made.collect()] == ["memory:document:2025-01-02:09-10-11.123:a", "memory:document:x:a", "memory:document:2025-01-02:20-10-11"]
    assert [r.v for r in made.select(paths.parts_of(F.col("k")).alias("v")).collect()] == [["2025-01-02", "09:10:11.123", "a"], ["x", "a"], ["2025-01-02", "20-10-11"]]
    assert values(spark, ["a:b", "", None], paths.parts_of) == [None, None, None]
    assert values(spark, ["../a\\b/c", "x" * 300, None], paths.file_name) == ["_a_b_c", "x" * 255, None]
    assert values(spark, ["a/Secret", "my private x", "workspace", "else", None], paths.path_class) == ["secret", "confidential", "internal", "public", None]
    assert values(spark, ["A" * 32, "a" * 31, "A" * 33 + "==", "0f" * 16, "has blank " * 5, "", None], paths.looks_sealed) == [True, False, True, True, False, False, None]


def test_outlines_of_numbers_and_records(spark):
    df = spark.createDataFrame([(1, "1. One\ntext\n1.1 Two\n1.1.1. Three\n1) no\n2.x no"), (2, None), (3, "")], "k long, t string")
    assert rows(sections.numbered_headings(df, "k", "t")) == [(1, 0, 1, "One"), (1, 2, 2, "Two"), (1, 3, 3, "Three")]
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "d": [1]}'), (2, None), (3, "text"), (4, "{}"), (5, "[1]")], "k long, t string")
    assert rows(sections.nested_sections(df, "k", "t")) == [(1, 1, "a"), (1, 1, "d"), (1, 2, "a.b"), (1, 3, "a.b.c")]
    assert rows(sections.nested_sections(df, "k", "t", 1)) == [(1, 1, "a"), (1, 1, "d")]


def test_shared_words_flat_fields_and_recent(spark):
    df = spark.createDataFrame([("a", 1, 0, "Vector STORES hold vectors"), ("b", 1, 5, "the vectors hold stores"), ("c", 1, 9, None), ("d", None, 0, "vectors")], "id string, doc long, start int, content string")
    assert rows(sections.shared_words(df, "doc", "start", "id", "content")) == [("a", "b", "stores vectors")]
    df = spark.createDataFrame([(1, "t", None, ["x", None, "y"]), (2, None, 3, None)], "id long, topic string, size int, nodes array<string>")
    assert rows(merging.flattened(df, "id", ["topic", "size"], "nodes")) == [(1, "tag:0", "x"), (1, "tag:2", "y"), (1, "topic", "t"), (2, "size", "3")]
    day = 86_400_000_000
    df = spark.createDataFrame([("m", 0, "read"), ("m", 30 * day, "write"), ("m", day, "read"), ("n", 5, "write")], "m string, us long, kind string")
    assert rows(merging.recent(df, "m", "us", 30, F.col("kind") == "read")) == [("m", 1, day)]
