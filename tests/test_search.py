import pytest

from engram.operators import search


def test_nearest_answers_every_query(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    queries = df.filter("id IN (1, 2, 5)").selectExpr("id AS query", "v AS wanted")
    got = {}
    for r in search.nearest(df, "id", "v", queries, 3).collect():
        got.setdefault(r.query, []).append((round(r.distance, 6), r.id))
    assert {q: sorted(found) for q, found in got.items()} == {1: [(0.0, 1), (0.0, 4), (pytest.approx(0.292893), 3)], 2: [(0.0, 2), (pytest.approx(0.292893), 3), (1.0, 1)], 5: [(1.0, 1), (1.0, 2), (1.0, 3)]}
    monkeypatch.setattr(search, "ROW_BLOCK", 2)
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    again = {(r.query, r.id) for r in search.nearest(df, "id", "v", queries, 3).collect()}
    assert again == {(q, i) for q, found in got.items() for _, i in found}


def test_neighbours_in_time_against_brute_force(spark):
    import random

    from engram.operators.search import neighbours_in_time

    rng = random.Random(3)
    rows = [(f"k{k:03d}", rng.choice([rng.randrange(0, 40_000), rng.randrange(0, 300), 500])) for k in range(300)] + [("none", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, us long, slot string, last int")
    for within, parts in ((1000, 60), (997, 7), (50, 1)):
        got = {(r.id, r.before, round(r.proximity, 9)) for r in neighbours_in_time(df, "id", "us", within, parts).collect()}
        ordered = sorted((u, i) for i, u in rows if u is not None)
        want = {(i, j, round(1 - (u - v) / within, 9)) for (v, j), (u, i) in zip(ordered, ordered[1:]) if u - v <= within}
        assert got == want


def test_near_duplicates(spark):
    from engram.operators.search import near_duplicates

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0]), (5, None), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = near_duplicates(df, "id", "v", df.filter("id IN (1, 4)").selectExpr("id AS query", "v AS wanted"), 0.95, 2).collect()
    assert {(r.query, r.id) for r in got} == {(1, 2), (1, 6)} and all(r.similarity > 0.99 for r in got)
