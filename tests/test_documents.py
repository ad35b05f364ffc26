from pyspark.sql import functions as F

from engram.functions import crypto
from engram.operators import documents, pairs, relations


def test_kinds_categories_outlines_and_answers(spark):
    code = "import os\ndef f(x):\n    return x;\n"
    df = spark.createDataFrame([(1, "# T\nbody\n## Sub part \nend"), (2, code), (3, "a job. Learn about url links. done"), (4, ""), (5, None)], "id int, t string")
    got = {r.id: r for r in documents.with_category(df, "t", "c").select("id", "c", documents.kind(F.col("t")).alias("k"), documents.answer(F.col("t"), "learn JOB").alias("a")).collect()}
    assert [got[k].k for k in range(1, 6)] == ["markdown", "code", "plain", "plain", None]
    assert [got[k].c for k in range(1, 6)] == ["general", "general", "reference", "general", None]
    assert got[3].a == "a job. Learn about url links" and got[4].a == "" and got[5].a is None
    assert [(r.nth, r.level, r.entry) for r in documents.outline(df, "id", "t").orderBy("nth").collect()] == [(0, 1, "- T"), (2, 2, "  - Sub part")]


def test_answers_of_any_length(spark):
    df = spark.createDataFrame([("a job here. " * 100,)], "t string")
    assert df.select(documents.answer(F.col("t"), "job", None).alias("a")).first().a == ". ".join(["a job here"] * 100)


def test_pairs(spark):
    memories = spark.createDataFrame([("a", "The red cat sat", 0, "s"), ("b", "red cat sat", 30_000_000, "s"), ("c", None, None, None), ("d", "", None, "s")], "key string, text string, us long, source string")
    linked = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("a", "gone")], "a string, b string")
    got = {(r.a, r.b): r for r in pairs.compare(linked, memories).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("c", "d")}
    assert (got["a", "b"].content, got["a", "b"].time, got["a", "b"].relation) == (1.0, 1.0, "similar") and abs(got["a", "b"].overall - 0.8) < 1e-9
    assert (got["a", "c"].content, got["a", "c"].time, got["a", "c"].places) == (0.0, 0.0, 0.0)
    assert got["c", "d"].content == 1.0 and got["c", "d"].relation == "similar"
    same = spark.createDataFrame([("abcd", "abxde"), ("", "x")], "x string, y string").select(pairs.same_places(F.col("x"), F.col("y")).alias("p")).collect()
    assert [r.p for r in same] == [0.6, 0.0]


def test_places_of_whole_texts(spark):
    memories = spark.createDataFrame([("a", "x" * 100 + "y" * 300, 0, "s"), ("b", "x" * 100 + "z" * 300, 0, "s")], "key string, text string, us long, source string")
    linked = spark.createDataFrame([("a", "b")], "a string, b string")
    assert pairs.compare(linked, memories).first().places == 0.25 and pairs.compare(linked, memories, 100).first().places == 1.0


def test_parents(spark):
    rows = [("c1", 1, ["A"]), ("c2", 1, ["A"]), ("c3", 1, ["A", "B"]), ("c3", 1, ["A", "B"]), ("c4", 2, ["A", "B"]), ("c5", 1, None), ("c6", None, ["A", "B"]), ("c7", 1, [])]
    got = relations.parents(spark.createDataFrame(rows, "id string, doc_id long, section_path array<string>")).collect()
    assert [(r.chunk_id, r.parent_id) for r in got] == [("c3", "c1")]


def test_encryption(spark):
    df = spark.createDataFrame([("text ü",), ("",), (None,)], "t string").withColumn("s", crypto.encrypt(F.col("t"), "k"))
    got = df.select("t", "s", crypto.decrypt(F.col("s"), "k").alias("back"), crypto.decrypt(F.col("s"), "other").alias("wrong")).collect()
    assert all(r.back == r.t and r.wrong is None and (r.s is None) == (r.t is None) and (r.t is None or r.s != r.t) for r in got)
