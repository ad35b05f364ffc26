"""Further queries over the memory store's tables, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import crypto
from engram.functions.text import STOP_WORDS, has_all_words
from engram.operators import documents as docs
from engram.operators import pairs, relations, search
from engram.plans.reference_queries import _EDGES, _SAID, _pairs
from engram.sources.tables import micros, table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    """Register a query and its SQL under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KIND = (
    "CASE WHEN " + " OR ".join(f"regexp_matches(text, '(?m){p}')" for p in docs.MARKDOWN) + " THEN 'markdown' WHEN " + " + ".join(f"regexp_matches(text, '(?m){p}')::INT" for p in docs.CODE) + " >= 3 THEN 'code' ELSE 'plain' END"
)


@query(f"SELECT doc_id, {_KIND} AS kind FROM documents WHERE text IS NOT NULL")
def document_types(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown, code or plain text."""
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", docs.kind(F.col("text")).alias("kind"))


_SCORES = [" + ".join(f"contains(lower(text), '{w}')::INT" for w in words) for words in docs.CATEGORIES.values()]
_BEST = f"greatest({', '.join(_SCORES)})"


@query(f"SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {_BEST} THEN '{name}'" for name, s in zip(docs.CATEGORIES, _SCORES, strict=True)) + " END AS category FROM documents WHERE text IS NOT NULL")
def document_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The category that most of a document's words speak for."""
    return docs.with_category(table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "text").drop("text")


@query(
    """WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines)))::INT AS nth FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT *, length(split_part(line, ' ', 1))::INT AS level FROM l WHERE regexp_matches(line, '^#{1,6} ')) SELECT doc_id, nth, level, repeat('  ', level - 1) || '- ' || trim(substr(line, level + 2)) AS entry FROM h"""
)
def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of all documents."""
    return docs.outline(table(spark, folder, "documents"), "doc_id", "text")


@query(
    """SELECT doc_id, substr(array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: contains(lower(s), 'vector') OR contains(lower(s), 'index')), '. '), 1, 500) AS answer
    FROM documents WHERE contains(lower(text), 'vector') AND contains(lower(text), 'index')"""
)
def answer_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """What documents say to a query."""
    hits = table(spark, folder, "documents").filter(has_all_words(F.col("text"), "vector index"))
    return hits.select("doc_id", docs.answer(F.col("text"), "vector index").alias("answer"))


@query(
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: contains(lower(s), 'vector') OR contains(lower(s), 'index')), '. ') AS answer
    FROM documents WHERE contains(lower(text), 'vector') AND contains(lower(text), 'index')"""
)
def answer_sentences_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All that documents say to a query."""
    hits = table(spark, folder, "documents").filter(has_all_words(F.col("text"), "vector index"))
    return hits.select("doc_id", docs.answer(F.col("text"), "vector index", None).alias("answer"))


_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"


@query(
    f"""WITH {_EDGES}, m AS (SELECT memory_key AS key, coalesce(text, '') AS text, epoch_us(created_at) AS us, source, {_WORDS} AS words FROM documents),
    p AS (SELECT e.a, e.b, x.text AS ta, y.text AS tb, x.words AS wa, y.words AS wb, abs(x.us - y.us) / 1e6 AS gap, (x.source = y.source)::INT::DOUBLE AS same FROM edges e JOIN m x ON x.key = e.a JOIN m y ON y.key = e.b),
    s AS (SELECT a, b, CASE WHEN len(wa) = 0 AND len(wb) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / greatest(len(wa) + len(wb) - len(list_intersect(wa, wb)), 1) END AS content, (ta = tb)::INT::DOUBLE AS structure,
        coalesce(CASE WHEN gap <= 60 THEN 1.0 WHEN gap <= 300 THEN 0.9 WHEN gap <= 3600 THEN 0.7 WHEN gap <= 86400 THEN 0.5 WHEN gap <= 604800 THEN 0.3 WHEN gap <= 2592000 THEN 0.1 END, 0.0)::DOUBLE AS time, coalesce(same, 0.5) AS metadata,
        CASE WHEN length(ta) = 0 OR length(tb) = 0 THEN 0.0 ELSE len(list_filter(range(1, least(length(ta), length(tb), 100) + 1), lambda i: substring(ta, i, 1) = substring(tb, i, 1))) / greatest(least(length(ta), 100), least(length(tb), 100)) END AS places FROM p),
    o AS (SELECT *, 0.5 * content + 0.2 * structure + 0.1 * time + 0.2 * metadata AS overall FROM s)
    SELECT a, b, round(content, 6) AS content, round(time, 6) AS time, round(places, 6) AS places, round(overall, 6) AS overall, CASE WHEN overall >= 0.95 THEN 'duplicate' WHEN time >= 0.7 AND content < 0.5 THEN 'temporal' WHEN structure >= 0.8 AND content < 0.5 THEN 'structural'
        WHEN overall >= 0.4 AND overall < 0.7 AND time >= 0.5 THEN 'complement' ELSE 'similar' END AS relation FROM o"""
)
def pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Matched documents compared by text, time and metadata; places are those of the first 100 characters."""
    documents = table(spark, folder, "documents")
    memories = documents.select(F.col("memory_key").alias("key"), "text", micros(documents, "created_at").alias("us"), "source")
    found = pairs.compare(_pairs(spark, folder), memories, 100)
    return found.select("a", "b", *(F.round(c, 6).alias(c) for c in ("content", "time", "places", "overall")), "relation")


@query(
    f"""WITH {_EDGES}, m AS (SELECT memory_key AS key, coalesce(text, '') AS text, epoch_us(created_at) AS us, source, {_WORDS} AS words FROM documents),
    p AS (SELECT e.a, e.b, x.text AS ta, y.text AS tb, x.words AS wa, y.words AS wb, abs(x.us - y.us) / 1e6 AS gap, (x.source = y.source)::INT::DOUBLE AS same FROM edges e JOIN m x ON x.key = e.a JOIN m y ON y.key = e.b),
    s AS (SELECT a, b, CASE WHEN len(wa) = 0 AND len(wb) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / greatest(len(wa) + len(wb) - len(list_intersect(wa, wb)), 1) END AS content, (ta = tb)::INT::DOUBLE AS structure,
        coalesce(CASE WHEN gap <= 60 THEN 1.0 WHEN gap <= 300 THEN 0.9 WHEN gap <= 3600 THEN 0.7 WHEN gap <= 86400 THEN 0.5 WHEN gap <= 604800 THEN 0.3 WHEN gap <= 2592000 THEN 0.1 END, 0.0)::DOUBLE AS time, coalesce(same, 0.5) AS metadata,
        CASE WHEN length(ta) = 0 OR length(tb) = 0 THEN 0.0 ELSE len(list_filter(list_zip(string_split(ta, ''), string_split(tb, ''), true), lambda p: p[1] = p[2])) / greatest(length(ta), length(tb)) END AS places FROM p),
    o AS (SELECT *, 0.5 * content + 0.2 * structure + 0.1 * time + 0.2 * metadata AS overall FROM s)
    SELECT a, b, round(content, 6) AS content, round(time, 6) AS time, round(places, 6) AS places, round(overall, 6) AS overall, CASE WHEN overall >= 0.95 THEN 'duplicate' WHEN time >= 0.7 AND content < 0.5 THEN 'temporal' WHEN structure >= 0.8 AND content < 0.5 THEN 'structural'
        WHEN overall >= 0.4 AND overall < 0.7 AND time >= 0.5 THEN 'complement' ELSE 'similar' END AS relation FROM o"""
)
def pair_similarity_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Matched documents compared by text, time and metadata, places over whole texts."""
    documents = table(spark, folder, "documents")
    memories = documents.select(F.col("memory_key").alias("key"), "text", micros(documents, "created_at").alias("us"), "source")
    found = pairs.compare(_pairs(spark, folder), memories)
    return found.select("a", "b", *(F.round(c, 6).alias(c) for c in ("content", "time", "places", "overall")), "relation")


@query(
    """WITH p AS (SELECT DISTINCT id, doc_id, array_to_string(section_path, ' > ') AS path, array_to_string(section_path[1:len(section_path) - 1], ' > ') AS up FROM chunks WHERE doc_id IS NOT NULL AND section_path IS NOT NULL),
    h AS (SELECT doc_id, path, min(id) AS parent_id FROM p GROUP BY 1, 2) SELECT p.doc_id, p.id AS chunk_id, h.parent_id FROM p JOIN h ON h.doc_id = p.doc_id AND h.path = p.up WHERE p.up <> ''"""
)
def hierarchical_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of the section above each chunk's."""
    return relations.parents(table(spark, folder, "chunks"))


@query(
    f"""WITH {_EDGES}, named AS (SELECT 'memory:document:' || doc_id AS node, unnest(regexp_extract_all(content, 'memory:[a-z]+:[0-9]+')) AS other FROM chunks WHERE content IS NOT NULL AND doc_id IS NOT NULL),
    every AS (SELECT node, other, weight AS score FROM ways UNION ALL SELECT node, other, 0.95 FROM named WHERE node <> other), best AS (SELECT node, other, max(score) AS score FROM every GROUP BY 1, 2)
    SELECT node, other, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS place FROM best) WHERE place <= 10"""
)
def related_memories(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories most related to each, by match or by being named."""
    matched = _pairs(spark, folder)
    ways = matched.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("weight").alias("score")).unionByName(matched.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("weight").alias("score")))
    chunks = table(spark, folder, "chunks").filter("doc_id IS NOT NULL").select(F.concat(F.lit("memory:document:"), F.col("doc_id")).alias("node"), "content")
    named = relations.references(chunks, "node", "content").filter("node <> ref").select("node", F.col("ref").alias("other"), F.lit(0.95).alias("score"))
    best = ways.unionByName(named).groupBy("node", "other").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "other"))  # limited before the shuffle too
    return best.withColumn("place", place).filter("place <= 10").withColumn("score", F.round("score", 6))


@query("SELECT source_id, target_id, edge_type FROM memory_edges e WHERE source_id LIKE 'memory:document:%' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.memory_key = e.source_id)")
def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from documents that are not stored."""
    stored = table(spark, folder, "documents").select(F.col("memory_key").alias("source_id"))
    return table(spark, folder, "memory_edges").filter("source_id LIKE 'memory:document:%'").select("source_id", "target_id", "edge_type").join(stored, "source_id", "left_anti")


@query(
    """WITH r AS (SELECT event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events), m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
    SELECT r.event_type, round(avg(r.value), 6) AS recent, round(any_value(m.mean), 6) AS mean, round(max(r.value) FILTER (r.place = 1), 6) AS latest FROM r JOIN m ON m.event_type = r.event_type WHERE place <= 5 GROUP BY 1"""
)
def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The latest value of each metric and the mean of its last five, against all."""
    events = table(spark, folder, "events")
    last = events.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).filter("place <= 5")
    recent = last.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("recent"), F.round(F.max(F.when(F.col("place") == 1, F.col("value"))), 6).alias("latest"))
    return recent.join(events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query(f"WITH {_SAID} SELECT doc_id, turn::INT AS turn, role, content FROM said WHERE turn BETWEEN 1 AND 3")
def message_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The second to fourth message of each chat."""
    return relations.messages(table(spark, folder, "documents"), "doc_id", "text").filter("turn BETWEEN 1 AND 3")


@query("SELECT id, event_type FROM audit_events WHERE ts < TIMESTAMP '2025-04-01' - INTERVAL 15 DAY")
def expired_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that a retention of 15 days lets go."""
    return table(spark, folder, "audit_events").filter("ts < timestamp_ntz'2025-04-01 00:00:00' - INTERVAL 15 DAYS").select("id", "event_type")


@query(
    """SELECT doc_id, CAST(date_trunc('week', created_at) AS DATE) AS week_start, CAST(date_trunc('week', created_at) AS DATE) + 6 AS week_end,
    CAST(date_trunc('month', created_at) - INTERVAL 1 MONTH AS DATE) AS month_before, CAST(date_trunc('month', created_at) AS DATE) - 1 AS month_before_end FROM documents WHERE created_at IS NOT NULL"""
)
def calendar_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The week of each document and the month before it."""
    at = F.col("created_at")
    week, month = F.date_trunc("week", at).cast("date"), F.trunc(at.cast("date"), "month")
    made = table(spark, folder, "documents").filter(at.isNotNull())
    return made.select("doc_id", week.alias("week_start"), F.date_add(week, 6).alias("week_end"), F.add_months(month, -1).alias("month_before"), F.date_sub(month, 1).alias("month_before_end"))


@query("SELECT source, count(*) AS documents, count(*) AS restored, 0::BIGINT AS opened_by_others FROM documents WHERE text IS NOT NULL GROUP BY source")
def encrypted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that come back whole from encryption, and those that another key opens."""
    given = table(spark, folder, "documents").filter("text IS NOT NULL").select("source", "text", crypto.encrypt(F.col("text"), "first").alias("secret"))
    return given.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(crypto.decrypt(F.col("secret"), "first") == F.col("text")).alias("restored"), F.count(crypto.decrypt(F.col("secret"), "second")).alias("opened_by_others"))


_PATTERNS = ("memory:document:1*", "memory:document:?", "memory:*:*99")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, count(DISTINCT resource) AS resources, count(*) AS events FROM audit_events WHERE resource GLOB '{p}'" for p in _PATTERNS))
def resource_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Resources and events under access patterns."""
    events = table(spark, folder, "audit_events").filter("resource IS NOT NULL").groupBy("resource").agg(F.count("*").alias("n"))
    out = None
    for p in _PATTERNS:
        one = search.by_pattern(events, "resource", p).agg(F.count("*").alias("resources"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")).select(F.lit(p).alias("pattern"), "resources", "events")
        out = one if out is None else out.unionByName(one)
    return out
