"""Measures of the memory graph, as joins and aggregates over undirected edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch
from engram.plans.skew import hot_keys, join_unique


def undirected(edges: DataFrame, source: str, target: str, weight: str, least: float) -> DataFrame:
    """Distinct edges a < b with their highest weight; rows with missing or equal ends or a weight below `least`, null or NaN are left out."""
    a, b, w = F.col(source), F.col(target), F.col(weight)
    kept = edges.filter(a.isNotNull() & b.isNotNull() & (a != b) & w.isNotNull() & ~F.isnan(w) & (w >= least))
    return kept.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(w).alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))


def degrees(pairs: DataFrame) -> DataFrame:
    """node, degree."""
    return both_ways(pairs).groupBy("node").agg(F.count("*").alias("degree"))


def centrality(pairs: DataFrame) -> DataFrame:
    """node, degree and degree centrality, degree / (n - 1)."""
    d = degrees(pairs)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


def lone_pairs(pairs: DataFrame) -> DataFrame:
    """Nodes with one neighbour which has no other neighbour either."""
    d = degrees(pairs).filter("degree = 1").select("node")
    ends = pairs.join(d.withColumnRenamed("node", "a"), "a", "left_semi").join(d.withColumnRenamed("node", "b"), "b", "left_semi")
    return both_ways(ends).select("node", F.col("other").alias("neighbour"))


def clustering(pairs: DataFrame) -> DataFrame:
    """node, degree, triangles and clustering coefficient 2T / (d (d - 1)), 0 below two neighbours.

    Each edge is directed from its end of lower degree, so a node has no more than sqrt(2 m) outgoing edges
    however many neighbours it has, and wedges are only built from those. Edges are written when this is called.
    """
    scratch = Scratch(pairs.sparkSession)
    pairs, seen = scratch.counted(pairs.select("a", "b"))
    d = scratch.write(degrees(pairs))
    hot = hot_keys(d, "node", "degree", 2 * seen["n"])
    ranked = pairs
    for side in ("a", "b"):
        rank = d.select(F.col("node").alias(side), F.col("degree").alias(f"d{side}"))
        ranked = join_unique(ranked, rank, side, None if hot is None else hot.withColumnRenamed("node", side), "inner")
    low = F.struct("da", "a") < F.struct("db", "b")
    out = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = out.join(out.withColumnRenamed("v", "w"), "u").filter("v < w")
    closed = wedges.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return d.join(corners, "node", "left").select("node", "degree", t.alias("triangles"), F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def density(pairs: DataFrame) -> DataFrame:
    """One row: nodes, edges, density."""
    n = degrees(pairs).agg(F.count("*").alias("nodes"))
    m = pairs.agg(F.count("*").alias("edges"))
    return n.crossJoin(F.broadcast(m)).select("nodes", "edges", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"))


def expand(base: DataFrame, links: DataFrame, depth: int = 2, fade: float = 0.8, least: float = 0.5) -> DataFrame:
    """Walk from base (node) along links (node, other, weight), up to `depth` steps: node, relevance, step.

    A step's relevance is the link's weight times fade to the power of the step; a walk stops below `least`.
    A node keeps its best relevance, then its first step; the base itself has relevance 1 and step 0.
    """
    reached = base.select("node", F.lit(1.0).alias("relevance"), F.lit(0).alias("step"))
    edge = reached
    for step in range(1, depth + 1):
        relevance = F.col("weight") * fade**step
        edge = edge.select("node").distinct().join(links, "node").select(F.col("other").alias("node"), relevance.alias("relevance"), F.lit(step).alias("step")).filter(relevance >= least)
        reached = reached.unionByName(edge)
    best = F.max(F.struct("relevance", (-F.col("step")).alias("early"))).alias("best")
    return reached.groupBy("node").agg(best).select("node", "best.relevance", (-F.col("best.early")).alias("step"))
