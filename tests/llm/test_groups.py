import random

from engram.llm.groups import components, valid_pairs


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "s string, t string, w double, a string, node string")
    out = components(valid_pairs(df, "s", "t", "w", 0.7)).collect()
    assert len(out) == len({r.node for r in out})
    return {r.node: r.group for r in out}


def test_chain_star_clique_and_dirt(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(200)]
    star = [("hub", f"leaf{k}") for k in range(300)]
    clique = [(f"q{i}", f"q{j}") for i in range(12) for j in range(12) if i != j]
    rng = random.Random(1)
    loose = [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(250)]
    pairs = [p for p in chain + star + clique + loose if p[0] != p[1]]
    dirt = [("chain", "hub", 0.69), ("c000", "hub", float("nan")), ("c000", "q0", None), (None, "q1", 1.0), ("hub", None, 1.0), ("self", "self", 1.0)]
    rows = [(*p, 0.7) for p in pairs] + [(b, a, 0.9) for a, b in pairs[:50]] + dirt
    assert found(spark, rows) == brute(pairs)


def test_one_row_is_enough_whatever_others_say(spark):
    assert found(spark, [("b", "a", 0.1), ("a", "b", 0.8), ("b", "a", None)]) == {"a": "a", "b": "a"}


def test_no_matches(spark):
    assert found(spark, []) == {} and found(spark, [("a", "a", 1.0), ("a", "b", 0.2)]) == {}


def test_hot_keys_give_the_same_groups(spark, monkeypatch):
    from engram.plans import skew

    monkeypatch.setattr(skew, "HOT_FLOOR", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    pairs = [("hub", f"leaf{k:03d}") for k in range(150)] + [(f"leaf{k:03d}", f"far{k:03d}") for k in range(100)] + [("x", "y")]
    assert found(spark, [(*p, 1.0) for p in pairs]) == brute(pairs)


def test_vertices_whose_numbers_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    from engram.llm import groups

    monkeypatch.setattr(groups, "_id", lambda v: F.pmod(F.xxhash64(v), F.lit(7)))
    pairs = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(0, 60, 2)]
    assert found(spark, [(*p, 1.0) for p in pairs]) == brute(pairs)


def test_orders_are_bijections_and_fresh(spark):
    from pyspark.sql import functions as F

    from engram.llm.groups import _mixed, _unmixed

    df = spark.range(0, 2000).select(F.xxhash64("id").alias("x"))
    orders = []
    for turn in range(3):
        rows = df.select("x", _mixed(F.col("x"), turn).alias("m"), _unmixed(_mixed(F.col("x"), turn), turn).alias("back")).collect()
        assert all(r.x == r.back for r in rows) and len({r.m for r in rows}) == 2000
        ranked = sorted(rows, key=lambda r: r.m)
        orders.append({r.x: k for k, r in enumerate(ranked)})
    for one, two in ((0, 1), (1, 2)):
        pairs = [(orders[one][a] < orders[one][b]) == (orders[two][a] < orders[two][b]) for a, b in zip(list(orders[0])[::2], list(orders[0])[1::2])]
        assert 0.45 < sum(pairs) / len(pairs) < 0.55


def test_rounds_are_few(spark):
    from engram.llm import groups
    from engram.plans.lineage import Scratch

    chain = spark.range(0, 4095).selectExpr("id AS a", "id + 1 AS b")
    scratch = Scratch(spark)
    edges, seen = scratch.counted(chain)
    maps = groups.contract(edges, seen["n"], scratch)
    sizes = [n for _, n in maps]
    assert sizes[0] == 4096 and len(maps) <= 12 and all(b <= 0.6 * a for a, b in zip(sizes[:5], sizes[1:]))
