"""Queries of the general data problems, and their SQL where SQL can state them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.instants import add_utc_micros
from engram.operators.sessions import once_per_id, session_kinds, sessions
from engram.sources.tables import micros, table

TIMED = (("audit_wire", "wire_id", "ts_text"), ("checksum_records", "rec_id", "created_at"), ("memory_clusters", "id", "created_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """UTC instants of all records whose text fixes exactly one; a repeated record comes out once."""
    parts = [table(spark, folder, name).select(F.lit(name).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text"), "site_id") for name, key, text in TIMED]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("rec_id IS NOT NULL AND text IS NOT NULL")
    sites = table(spark, folder, "sites").select("site_id", "tz_name", "date_order")
    found = add_utc_micros(records.join(sites, "site_id", "left"), "text", "tz_name", "date_order")
    # filtered after the aggregation: a filter on a computed column would be pushed down and repeat its expression
    return found.groupBy("src", "rec_id").agg(F.min("utc_us").alias("utc_us")).filter("utc_us IS NOT NULL")


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "audit_events").filter("principal_id IS NOT NULL AND ts IS NOT NULL")
    events = events.select("id", micros(events, "ingested_at").alias("ingested"), "principal_id", micros(events, "ts").alias("us"), F.lower("event_type").alias("event_type"))
    return once_per_id(events, "id", ["ingested"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each principal's audit events, gap 30 minutes."""
    return sessions(_activity(spark, folder), "principal_id", "us").select("principal_id", "start_us", "end_us", "n_events")


def p4_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with their duration."""
    return sessions(_activity(spark, folder), "principal_id", "us")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by event type, in lower case, of each session."""
    events = _activity(spark, folder)
    return session_kinds(events, "principal_id", "us", F.col("event_type")).withColumnRenamed("kind", "event_type")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_durations": p4_durations, "p4_kinds": p4_kinds}

_RUNS = """
WITH once AS (SELECT id, arg_min(principal_id, ingested_at) AS principal_id, arg_min(epoch_us(ts), ingested_at) AS us, lower(arg_min(event_type, ingested_at)) AS event_type
              FROM (SELECT *, CASE WHEN id IS NULL THEN row_number() OVER () END AS nameless FROM audit_events) WHERE principal_id IS NOT NULL AND ts IS NOT NULL GROUP BY id, nameless),
     gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY principal_id ORDER BY us, id) AS gap FROM once),
     runs AS (SELECT *, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY principal_id ORDER BY us, id) AS run FROM gaps),
     spans AS (SELECT principal_id, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM runs GROUP BY principal_id, run)
"""
ORACLE_SQL = {
    "p4_found": _RUNS + "SELECT principal_id, start_us, end_us, n_events FROM spans",
    "p4_durations": _RUNS + "SELECT principal_id, start_us, end_us, end_us - start_us AS duration_us, n_events FROM spans",
    "p4_kinds": _RUNS + """SELECT r.principal_id, s.start_us, s.end_us, r.event_type, count(*) AS n_events FROM runs r JOIN spans s ON r.principal_id = s.principal_id AND r.run = s.run
                           GROUP BY r.principal_id, s.start_us, s.end_us, r.event_type""",
}
