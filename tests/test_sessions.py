import random

from pyspark.sql import functions as F

from engram.operators.sessions import GAP_US, once_per_id, session_kinds, sessions

SCHEMA = "who string, us long, kind string, _slot string"


def brute(rows):
    out = []
    by = {}
    for who, us, *_ in rows:
        if who is not None and us is not None:
            by.setdefault(who, []).append(us)
    for who, times in by.items():
        times.sort()
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > GAP_US:
                out.append((who, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((who, run[0], run[-1], len(run)))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((r.who, r.start_us, r.end_us, r.n_events) for r in sessions(df, "who", "us").collect())


def test_gap_of_exactly_thirty_minutes_belongs_together(spark):
    rows = [("a", 0), ("a", GAP_US), ("a", 2 * GAP_US + 1), ("b", 5), ("b", 5), (None, 1), ("a", None)]
    assert found(spark, rows) == [("a", 0, GAP_US, 2), ("a", 2 * GAP_US + 1, 2 * GAP_US + 1, 1), ("b", 5, 5, 2)]


def test_random_events_with_a_hot_principal_and_long_sessions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(-40 * GAP_US, 40 * GAP_US)) for _ in range(600)]
    rows += [("long", k * (GAP_US - 7)) for k in range(150)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_kinds_add_up(spark):
    df = spark.createDataFrame([("a", 0, "read", ""), ("a", 10, "read", ""), ("a", 20, None, ""), ("a", 9 * GAP_US, "write", "")], SCHEMA)
    got = sorted(((r.start_us, r.kind, r.n_events) for r in session_kinds(df, "who", "us", F.col("kind")).collect()), key=str)
    assert got == [(0, "read", 2), (0, None, 1), (9 * GAP_US, "write", 1)]


def test_once_per_id_takes_the_first_and_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("i", 2, "late", {"a": "1"}), ("i", 1, "early", {"b": "2"}), (None, 5, "x", None), (None, 5, "x", None)], "id string, at int, what string, metadata map<string,string>")
    got = sorted((str(r.id), r.what) for r in once_per_id(df, "id", ["at"]).collect())
    assert got == [("None", "x"), ("None", "x"), ("i", "early")]
