"""Queries of the training-data problems, and their SQL where SQL can state them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.garbled import garbled_lines
from engram.llm.groups import components, valid_pairs
from engram.llm.mixing import mixture
from engram.llm.neighbours import top_similar
from engram.llm.pii import masked, mentions
from engram.llm.tokens import token_ids
from engram.sources.tables import table

LEAST_WEIGHT = 0.70


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Group identifier of every memory in at least one match."""
    pairs = valid_pairs(table(spark, folder, "memory_edges"), "source_id", "target_id", "weight", LEAST_WEIGHT)
    return components(pairs).select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


def p1_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with the number of their memories."""
    return p1_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("n_nodes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's 10 most similar."""
    near = top_similar(table(spark, folder, "chunk_data"), "id", "embedding")
    return near.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id", "content").unionByName(table(spark, folder, "chunk_data").select("id", "content"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal data in all chunks, counted by kind from the left."""
    found = mentions(_contents(spark, folder), "id", "content")
    return found.select(F.col("id").alias("chunk_id"), "kind", "nth").distinct()


def p5_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of all chunks with placeholders in place of personal data."""
    return _contents(spark, folder).select(F.col("id").alias("chunk_id"), masked(F.col("content")).alias("content"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("named"), "text")
    return token_ids(named, "named", "text").select("named.*", F.size("ids").alias("tokens"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of documents: how many copies of each."""
    return mixture(_sized(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target shares and the shares really reached."""
    return mixture(_sized(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which something was read in a wrong encoding."""
    return garbled_lines(table(spark, folder, "documents"), "doc_id", "source", ["text"]).select(F.col("key").alias("doc_id")).distinct()


def p8_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled lines with the chain of encodings and, where it can be had back, the original."""
    return garbled_lines(table(spark, folder, "documents"), "doc_id", "source", ["text"]).withColumnRenamed("key", "doc_id").withColumn("probability", F.round("probability", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_sizes, p3_found, p5_found, p5_masked, p6_ids, p7_mixture, p7_shares, p8_found, p8_lines)}

_GROUPS = """
WITH RECURSIVE links AS (SELECT DISTINCT source_id AS a, target_id AS b FROM memory_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id AND weight >= 0.70 AND NOT isnan(weight)),
     both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
     reach(node_id, group_id) USING KEY (node_id) AS (
        SELECT a, a FROM both_ways GROUP BY a
        UNION
        SELECT l.b, min(r.group_id) FROM reach r JOIN both_ways l ON l.a = r.node_id JOIN recurring.reach o ON o.node_id = l.b WHERE r.group_id < o.group_id GROUP BY l.b)
"""
_USABLE = """
WITH once AS (SELECT id, min(embedding)::DOUBLE[64] AS v FROM chunk_data WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
     ranked AS (SELECT a.id AS id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY array_cosine_similarity(a.v, b.v) DESC, b.id) AS place FROM once a JOIN once b ON a.id <> b.id)
"""
ORACLE_SQL = {
    "p1_found": _GROUPS + "SELECT node_id, group_id FROM reach",
    "p3_found": _USABLE + "SELECT DISTINCT least(id, other) AS a_id, greatest(id, other) AS b_id FROM ranked WHERE place <= 10",
    "p1_sizes": _GROUPS + "SELECT group_id, count(*) AS n_nodes FROM reach GROUP BY group_id",
}
