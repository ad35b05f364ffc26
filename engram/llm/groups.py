"""Groups of linked records by randomised contraction.

Each round every vertex hooks to the vertex of its closed neighbourhood that comes first in a fresh
hash order; edges are relabelled, loops and repeats dropped, and the mapping vertex -> hook is
written. A round removes a constant share of the vertices in expectation whatever the graph's shape
(long chains, stars, dense groups), so about log(vertices) rounds are enough. The mappings are then
expanded from the last round back to the first.

Vertices are numbers: 64-bit hashes of the ids, checked to be free of collisions. A round's order is
a bijection of the numbers that can be undone, so hooking is a plain min() of longs and nothing but
longs is shuffled until the ids come back at the end.

Hubs: min() combines before the shuffle, and relabelling and expansion go through joins in which hot
keys, whose number is bounded by counting, meet a broadcast.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch
from engram.plans.skew import HOT_FLOOR, hot_from, hot_keys, join_unique

#: Mappings are expanded by so many rounds at a time before the result is written.
EXPAND = 4


def valid_pairs(edges: DataFrame, source: str, target: str, weight: str, least: float) -> DataFrame:
    """Pairs a < b of rows with two different given ends and a weight, not NaN, of at least `least`; repeated ones stay."""
    a, b, w = F.col(source), F.col(target), F.col(weight)
    kept = edges.filter(a.isNotNull() & b.isNotNull() & (a != b) & w.isNotNull() & ~F.isnan(w) & (w >= least))
    return kept.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


LOW = 0xFFFFFFFF


def _mixed(number: Column, turn: int) -> Column:
    """A bijection of 64-bit numbers, fresh in each turn: three rounds that hash one half of the bits, with a key of the
    turn, into the other half."""
    left, right = F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(LOW))
    for k in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(3 * turn + k)).bitwiseAND(F.lit(LOW)))
    return F.shiftleft(left, 32).bitwiseOR(right)


def _unmixed(number: Column, turn: int) -> Column:
    left, right = F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(LOW))
    for k in (2, 1, 0):
        left, right = right.bitwiseXOR(F.xxhash64(left, F.lit(3 * turn + k)).bitwiseAND(F.lit(LOW))), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def _hot(rows: DataFrame, key: str, size: int) -> DataFrame | None:
    return hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, "n", size)


def _id(vertex: Column) -> Column:
    return F.xxhash64(vertex)


def _numbered(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Vertices with a number each (node, id), the pairs by number, each once with a < b, and how many pairs there are.

    The number is a hash, so pairs need no join to get theirs. That no two vertices share one is checked; where two do,
    vertices are counted through instead and pairs joined with their numbers.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = scratch.write(ends.withColumn("id", _id(F.col("node"))))
    a, b = _id(F.col("a")), _id(F.col("b"))
    if not nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        nodes = scratch.write(nodes.select("node", F.monotonically_increasing_id().alias("id")))
        rows = pairs.count()
        for end in ("a", "b"):
            pairs = join_unique(pairs, nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}2")), end, _hot(pairs, end, rows), "inner")
        a, b = F.col("a2"), F.col("b2")
    numbered, seen = scratch.counted(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    return nodes, numbered, seen["n"]


def contract(edges: DataFrame, n: int, scratch: Scratch) -> list[tuple[DataFrame, int]]:
    """Rounds of hooking and relabelling until no edge is left: the mapping node -> hook of each, and its size.

    edges: a < b, each once, written, n of them. A round writes two tables and runs nothing else, unless a vertex may be hot.
    """
    maps: list[tuple[DataFrame, int]] = []
    while n:
        turn = len(maps)
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy(F.col("a").alias("node")).agg(F.min(_mixed(F.col("b"), turn)).alias("best"), F.count("*").alias("links"))
        hooks, seen = scratch.counted(best.select("node", _unmixed(F.least(_mixed(F.col("node"), turn), F.col("best")), turn).alias("hook"), "links"), most=F.max("links"))
        maps.append((hooks, seen["n"]))
        # links are a vertex's rows among both ends of all edges
        hot = hot_keys(hooks, "node", "links", 2 * n) if seen["most"] > hot_from(2 * n) else None
        to, moved = hooks.select("node", "hook"), edges
        for end in ("a", "b"):
            at = None if hot is None else hot.withColumnRenamed("node", end)
            moved = join_unique(moved, to.withColumnRenamed("node", end).withColumnRenamed("hook", f"{end}2"), end, at, "inner").drop(end)
        then, seen = scratch.counted(moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        scratch.drop(edges)
        edges, n = then, seen["n"]
    return maps


def components(pairs: DataFrame) -> DataFrame:
    """One row per vertex of `pairs` (a, b): node, group; group is the smallest node linked to it, itself included.

    Null ends, loops and repeated pairs in either direction do no harm; no pairs give no rows. The rounds run when this is
    called.
    """
    scratch = Scratch(pairs.sparkSession)
    names, edges, n = _numbered(pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), scratch)
    maps = contract(edges, n, scratch)
    if not maps:
        return names.select("node", F.col("node").alias("group"))
    last, size = maps.pop()
    found, steps = last.select("node", F.col("hook").alias("root")), 0
    while maps:
        above, size = maps.pop()
        above = above.select("node", "hook")
        hot = _hot(above, "hook", size) if size > HOT_FLOOR else None
        found = join_unique(above, found.select(F.col("node").alias("hook"), "root"), "hook", hot).select("node", F.coalesce("root", "hook").alias("root"))
        steps += 1
        if steps % EXPAND == 0 or hot is not None:
            found = scratch.write(found)
    named = scratch.write(found.withColumnRenamed("node", "id").join(names, "id").select("node", "root"))
    scratch.keep(named)
    smallest = named.groupBy("root").agg(F.min("node").alias("group"))
    return join_unique(named, smallest, "root", _hot(named, "root", size), "inner").select("node", "group")
