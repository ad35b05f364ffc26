"""Queries over records, their fields and parts of texts, each with its SQL.

The SQL states its constants itself, so that a wrong one in the library shows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import crypto, paths, scoring
from engram.operators import audit, integrity, merging, pairs, relations, search, sections
from engram.plans.more_queries import ORACLE_SQL as _MORE
from engram.plans.reference_queries import _EACH, _pairs, _wanted
from engram.sources.tables import micros, table

QUERIES = {}
ORACLE_SQL = {}
FIELDS = ("event_type", "action", "result", "ip_address", "agent")
#: 2026-01-01, in microseconds.
AS_OF_US = 1_767_225_600_000_000


def query(sql: str):
    """Register a query and its SQL under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "audit_events")
    given = events.select("id", F.col("resource").alias("memory"), micros(events, "ts").alias("us"), F.lower("event_type").alias("event_type"), "action", "result", "ip_address", F.try_element_at("metadata", F.lit("agent")).alias("agent"), "risk_score")
    return given.filter("id IS NOT NULL AND memory IS NOT NULL AND us IS NOT NULL").distinct()


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return merging.facts(_records(spark, folder), "id", "memory", "us", FIELDS)


_E = "e AS (SELECT DISTINCT id, resource AS memory, epoch_us(ts) AS us, lower(event_type) AS event_type, action, result, ip_address, element_at(metadata, 'agent')[1] AS agent, risk_score FROM audit_events WHERE id IS NOT NULL AND resource IS NOT NULL AND ts IS NOT NULL)"
_F = _E + ", facts AS (" + " UNION ALL ".join(f"SELECT id, memory, us, '{f}' AS field, {f} AS value FROM e" for f in ("event_type", "action", "result", "ip_address", "agent")) + ")"
_BEST = "p AS (SELECT memory, id, round(0.7 * coalesce(risk_score, 0.5) + 0.3 * greatest(0, 1 - floor((1767225600000000 - us) / 86400000000.0) / 365), 9) AS worth FROM e), best AS (SELECT memory, id, worth FROM p QUALIFY row_number() OVER (PARTITION BY memory ORDER BY worth DESC, id) = 1)"


@query(f"WITH {_F} SELECT memory, field, value FROM facts WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory, field ORDER BY us DESC, id DESC) = 1")
def merged_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Each memory's fields after a merge in which newer values replace older ones."""
    return merging.newest_values(_facts(spark, folder))


@query(f"WITH {_F} SELECT memory, field, value, count(*) AS times, min(us) AS first_us FROM facts WHERE value IS NOT NULL GROUP BY ALL")
def combined_values(spark: SparkSession, folder: str) -> DataFrame:
    """Each memory's fields after a merge that keeps all values."""
    return merging.all_values(_facts(spark, folder))


@query(f"WITH {_E}, {_BEST} SELECT * FROM best")
def primary_records(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each memory that leads a merge, by importance and recency."""
    return merging.primaries(_records(spark, folder), "id", "memory", "us", "risk_score", AS_OF_US)


@query(
    f"""WITH {_F}, {_BEST}, known AS (SELECT DISTINCT f.memory, f.field, f.value FROM facts f JOIN best b ON b.memory = f.memory AND b.id = f.id)
    SELECT f.memory, f.field, f.value, count(*) AS times FROM facts f LEFT JOIN known k ON k.memory = f.memory AND k.field = f.field WHERE f.value IS NOT NULL AND f.value IS DISTINCT FROM k.value GROUP BY ALL"""
)
def merge_additions(spark: SparkSession, folder: str) -> DataFrame:
    """What the other records of a memory add to its primary one."""
    primary = merging.primaries(_records(spark, folder), "id", "memory", "us", "risk_score", AS_OF_US)
    return merging.additions(_facts(spark, folder), primary)


@query(f"WITH {_E} SELECT memory, (to_timestamp(0) AT TIME ZONE 'UTC' + to_microseconds(us))::DATE AS day, count(*) AS children, min(us) AS first_us, max(us) AS last_us, arg_min(id, (us, id)) AS first_child, arg_max(id, (us, id)) AS last_child FROM e GROUP BY 1, 2")
def daily_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A parent for the records of each memory and day."""
    return merging.summaries(_records(spark, folder), "id", "memory", "us")


@query(f"SELECT a, count(*) AS pairs, CASE WHEN bool_and(relation = 'duplicate') THEN 'keep_newest' WHEN bool_or(relation = 'temporal') THEN 'hierarchical' WHEN bool_or(relation = 'complement') THEN 'combine' ELSE 'importance' END AS strategy FROM ({_MORE['pair_similarity_whole']}) GROUP BY a")
def merge_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """How a document and those matched with it would be merged."""
    documents = table(spark, folder, "documents")
    memories = documents.select(F.col("memory_key").alias("key"), "text", micros(documents, "created_at").alias("us"), "source")
    return merging.strategies(pairs.compare(_pairs(spark, folder), memories), "a", "relation")


@query(
    f"""WITH {_F}, target AS (SELECT id, field, CASE WHEN field = 'result' AND us % 11 = 0 THEN value || '!' ELSE value END AS value FROM facts WHERE NOT (field = 'agent' AND us % 7 = 0) UNION ALL SELECT id, 'seen', 'yes' FROM e WHERE us % 13 = 0),
    d AS (SELECT coalesce(f.id, t.id) AS id, coalesce(f.field, t.field) AS field, CASE WHEN t.id IS NULL THEN 'missing' WHEN f.id IS NULL THEN 'extra' WHEN f.value IS DISTINCT FROM t.value THEN 'value' END AS difference FROM facts f FULL JOIN target t ON t.id = f.id AND t.field = f.field)
    SELECT id, field, difference FROM d WHERE difference IS NOT NULL"""
)
def field_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Records against a copy with fields missing, added and altered."""
    facts = _facts(spark, folder)
    value = F.when((F.col("field") == "result") & (F.col("us") % 11 == 0), F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    copied = facts.filter(~((F.col("field") == "agent") & (F.col("us") % 7 == 0))).select("id", "field", value.alias("value"))
    added = _records(spark, folder).filter("us % 13 = 0").select("id", F.lit("seen").alias("field"), F.lit("yes").alias("value"))
    return merging.differences(facts, copied.unionByName(added))


@query("SELECT k.field, k.value, count(*) AS records FROM (SELECT DISTINCT id, unnest(map_entries(map_concat(coalesce(metadata, MAP {}), CASE WHEN risk_score >= 0.5 THEN MAP {'reviewed': 'no', 'agent': 'patch'} ELSE MAP {} END))) AS e FROM audit_events WHERE id IS NOT NULL), LATERAL (SELECT e.key AS field, e.value AS value) k GROUP BY 1, 2")
def patched_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all records' metadata after a partial update of those with some risk."""
    events = table(spark, folder, "audit_events").filter("id IS NOT NULL").select("id", "metadata", "risk_score")
    patch = F.create_map(F.lit("reviewed"), F.lit("no"), F.lit("agent"), F.lit("patch"))
    patches = events.filter("risk_score >= 0.5").select("id").distinct().withColumn("patch", patch)
    after = merging.patched(events, patches, "id", "metadata").select("id", F.explode("metadata").alias("field", "value")).distinct()
    return after.groupBy("field", "value").agg(F.count("*").alias("records"))


@query(f"WITH {_E}, n AS (SELECT memory, us // 1000 AS ms, row_number() OVER (PARTITION BY memory, us // 1000 ORDER BY us, id) - 1 AS nth, id FROM e) SELECT memory AS log, ms || '-' || nth AS entry, id, ms AS at_ms FROM n")
def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a log per memory, with entry ids and the times read back from them."""
    logged = merging.log_entries(_records(spark, folder), "memory", "us", "id")
    return logged.withColumn("at_ms", merging.entry_millis(F.col("entry")))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'conversation' WHEN 1 THEN 'state' WHEN 2 THEN 'system' WHEN 3 THEN 'conversation' ELSE 'document' END AS kind FROM documents WHERE text IS NOT NULL")
def record_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of JSON records made of the documents: a message, a checkpoint, a metric, a message with a state, a title, and bare text."""
    text = F.col("text")
    bodies = [F.struct(text.alias("message"), F.lit("user").alias("role")), F.struct(text.alias("progress")), F.struct(text.alias("metric")), F.struct(F.lit(1).alias("state"), text.alias("conversation")), F.struct(text.alias("title"))]
    content = text
    for k, body in enumerate(bodies):
        content = F.when(F.col("doc_id") % 6 == k, F.to_json(body)).otherwise(content)
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", paths.kind_of(content).alias("kind"))


@query(
    """WITH p AS (SELECT doc_id, created_at, source, CASE doc_id % 5 WHEN 0 THEN strftime(created_at, '%Y-%m-%d/%H:%M:%S') WHEN 1 THEN strftime(created_at, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN '2025-02-30/10:00:00' ELSE strftime(created_at, '%Y-%m-%d/%H:%M:%S.%g') END || CASE WHEN doc_id % 5 <> 3 THEN coalesce('/' || source, '') ELSE '' END AS path FROM documents WHERE created_at IS NOT NULL)
    SELECT doc_id, path, CASE WHEN doc_id % 5 NOT IN (1, 2) THEN created_at::DATE END AS day, CASE doc_id % 5 WHEN 0 THEN epoch_us(date_trunc('second', created_at)) ELSE CASE WHEN doc_id % 5 > 2 THEN epoch_us(created_at) // 1000 * 1000 END END AS at_us,
        CASE WHEN doc_id % 5 IN (0, 4) THEN source END AS category, CASE doc_id % 5 WHEN 0 THEN false WHEN 3 THEN true WHEN 4 THEN true END AS has_ms, doc_id % 5 <> 1 AS dated, doc_id % 5 <> 1 AS timed FROM p"""
)
def time_path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What time paths say, some of them none or of days that do not exist; whether their parts look like a date and a time."""
    documents = table(spark, folder, "documents").filter("created_at IS NOT NULL")
    kind, made = F.col("doc_id") % 5, lambda shape: F.date_format("created_at", shape)
    path = F.when(kind == 0, made("yyyy-MM-dd/HH:mm:ss")).when(kind == 1, made("yyyy/MM/dd HH:mm:ss")).when(kind == 2, "2025-02-30/10:00:00").otherwise(made("yyyy-MM-dd/HH:mm:ss.SSS"))
    documents = documents.select("doc_id", F.concat(path, F.when(kind != 3, F.coalesce(F.concat(F.lit("/"), "source"), F.lit(""))).otherwise("")).alias("path"))
    part = F.split("path", "/")
    return documents.select("doc_id", "path", paths.read_time_path(F.col("path")).alias("read"), paths.is_date(part[0]).alias("dated"), paths.is_time(F.get(part, F.lit(1))).alias("timed")).select("doc_id", "path", "read.*", "dated", "timed")


_REFERENCE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {sure}::DOUBLE AS confidence, len(regexp_extract_all(text, '{pattern}', 0, 'i')) AS times FROM documents"
    for pattern, kind, sure in (
        (r"document\s*[''\"]?([^''\"]+)[''\"]?", "explicit", 0.9),
        (r"([^\s]+\.(?:pdf|doc|docx|txt|md))", "explicit", 0.95),
        (r"file\s*[''\"]?([^''\"]+)[''\"]?", "explicit", 0.85),
        (r"(?:previously|earlier|before)\s*(?:seen|read|checked)\s*(.+?)(?:in|from)", "implicit", 0.7),
        (r"(?:that|this|the)\s*(?:document|material|content)", "implicit", 0.6),
        (r"(?:as\s+)?mentioned\s+above", "implicit", 0.65),
        (r"(?:related|about)\s*(?:document|material)", "topic", 0.5),
    )
)


@query(f"SELECT doc_id, kind, max(confidence) AS confidence, sum(times)::BIGINT AS times, round((CASE kind WHEN 'explicit' THEN 0.9 WHEN 'implicit' THEN 0.6 ELSE 0.3 END + 1.8) / 4, 6) AS strength FROM ({_REFERENCE_SQL}) WHERE times > 0 GROUP BY doc_id, kind")
def text_references(spark: SparkSession, folder: str) -> DataFrame:
    """References to other documents in all texts, by kind, with confidence and strength."""
    found = table(spark, folder, "documents").select("doc_id", F.explode(paths.references(F.col("text"))).alias("r")).select("doc_id", "r.*")
    summed = found.groupBy("doc_id", "kind").agg(F.max("confidence").alias("confidence"), F.sum("times").alias("times"))
    return summed.withColumn("strength", F.round(paths.link_strength(F.col("kind")), 6))


@query("SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 23 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM documents WHERE text IS NOT NULL")
def checksum_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Checksums of a manifest against those of a copy with rows lost and altered."""
    documents = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    kept = integrity.manifest(documents, "doc_id", "text").select("doc_id", F.upper("sha256").alias("stored"))
    text = F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    copied = documents.filter("doc_id % 17 <> 0").select("doc_id", F.sha2(text, 256).alias("found"))
    same = F.lower("stored") == F.lower("found")  # hexadecimal digits in either case
    return kept.join(copied, "doc_id", "left").select("doc_id", F.when(F.col("found").isNull(), "missing").when(same, "ok").otherwise("mismatch").alias("state"))


@query(f"WITH {_F} SELECT field, count(*) AS records, count(value) FILTER (field IN ('ip_address', 'agent')) AS hidden, count(value) AS restored, count(value) FILTER (field NOT IN ('ip_address', 'agent')) AS plain, 0::BIGINT AS opened_by_others, count(value) FILTER (field IN ('ip_address', 'agent')) AS secrets FROM facts GROUP BY field")
def encrypted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Records in which named fields are encrypted: what is hidden, what comes back, and how many secrets differ."""
    facts = _facts(spark, folder)
    secret = F.when(F.col("field").isin("ip_address", "agent"), crypto.encrypt(F.col("value"), "first")).otherwise(F.col("value"))
    kept = facts.select("field", "value", secret.alias("stored"))
    back = F.when(F.col("field").isin("ip_address", "agent"), crypto.decrypt(F.col("stored"), "first")).otherwise(F.col("stored"))
    other = F.when(F.col("field").isin("ip_address", "agent"), crypto.decrypt(F.col("stored"), "second"))
    named = F.when(F.col("field").isin("ip_address", "agent"), F.col("stored"))
    return kept.groupBy("field").agg(
        F.count("*").alias("records"), F.count_if(F.col("stored") != F.col("value")).alias("hidden"), F.count_if(back == F.col("value")).alias("restored"), F.count_if(F.col("stored") == F.col("value")).alias("plain"), F.count(other).alias("opened_by_others"), F.count_distinct(named).alias("secrets")
    )


@query(
    """WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```([A-Za-z0-9_+-]*)\\n(.*?)```', 1) AS languages, regexp_extract_all(text, '(?s)```([A-Za-z0-9_+-]*)\\n(.*?)```', 2) AS codes FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, nth::INT AS nth, languages[nth + 1] AS language, codes[nth + 1] AS code FROM (SELECT *, unnest(range(len(codes))) AS nth FROM b)"""
)
def code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Fenced code blocks of all documents."""
    return sections.code_blocks(table(spark, folder, "documents"), "doc_id", "text")


_LINES = "l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines)))::INT AS nth FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"


@query(
    f"""WITH {_LINES}, t AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM l WHERE regexp_matches(line, '^\\s*\\|.*\\|\\s*$'))
    SELECT doc_id, min(nth) AS first, count(*) AS lines, max(len(string_split(trim(line), '|')) - 2)::INT AS columns FROM t GROUP BY doc_id, run HAVING count(*) >= 2"""
)
def text_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables drawn with bars in all documents."""
    return sections.tables(table(spark, folder, "documents"), "doc_id", "text")


_SECTIONS = f"""{_LINES}, p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, sum(length(line) + 1) OVER (PARTITION BY doc_id)::INT - 1 AS whole FROM l),
    h AS (SELECT doc_id, start, whole, length(split_part(line, ' ', 1))::INT AS level, trim(substr(line, length(split_part(line, ' ', 1)) + 2)) AS title FROM p WHERE regexp_matches(line, '^#{{1,6}} ')),
    s AS (SELECT h.doc_id, h.start, coalesce((SELECT min(n.start) FROM h n WHERE n.doc_id = h.doc_id AND n.start > h.start AND n.level <= h.level), h.whole)::INT AS "end", h.level, h.title FROM h)"""


@query(f"WITH {_SECTIONS} SELECT * FROM s")
def text_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of all documents with their extent."""
    return sections.sections(table(spark, folder, "documents"), "doc_id", "text")


@query(f"WITH {_SECTIONS}, o AS (SELECT DISTINCT id, doc_id, start_pos FROM chunks WHERE doc_id IS NOT NULL AND start_pos IS NOT NULL) SELECT o.id, o.doc_id, o.start_pos, s.level, s.title FROM o JOIN s ON s.doc_id = o.doc_id AND s.start <= o.start_pos AND o.start_pos < s.\"end\" QUALIFY row_number() OVER (PARTITION BY o.id, o.doc_id, o.start_pos ORDER BY s.level DESC, s.start DESC) = 1")
def deepest_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The deepest section of its document in which each chunk begins."""
    found = sections.sections(table(spark, folder, "documents"), "doc_id", "text")
    offsets = table(spark, folder, "chunks").filter("doc_id IS NOT NULL AND start_pos IS NOT NULL").select("id", "doc_id", "start_pos").distinct()
    return sections.deepest(found, offsets, "doc_id", "start_pos")


@query(
    """WITH c AS (SELECT DISTINCT id, doc_id, start_pos, content FROM chunks WHERE doc_id IS NOT NULL)
    SELECT id, trim(lag(right(content, 100)) OVER w) AS before, trim(lead(left(content, 100)) OVER w) AS behind FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos NULLS FIRST, id NULLS FIRST)"""
)
def chunk_surroundings(spark: SparkSession, folder: str) -> DataFrame:
    """What stands before and behind each chunk in its document."""
    chunks = table(spark, folder, "chunks").select("id", "doc_id", "start_pos", "content").distinct()
    return sections.surroundings(chunks, "doc_id", "start_pos", "id", "content")


#: Bursts that these tables hold.
BURSTS = (("reads", ("read",), 3, 60, 0.7), ("failed_logins", ("login_failed",), 2, 60, 0.8), ("deletions", ("delete",), 2, 30, 0.9))


@query(
    " UNION ALL ".join(
        f"SELECT id, principal_id, '{name}' AS pattern, n, {risk}::DOUBLE AS risk FROM (SELECT id, principal_id, count(*) OVER (PARTITION BY principal_id ORDER BY epoch_us(ts) RANGE BETWEEN {minutes * 60_000_000} PRECEDING AND CURRENT ROW) AS n FROM audit_events WHERE lower(event_type) = '{kind}' AND ts IS NOT NULL AND principal_id IS NOT NULL) WHERE n >= {least}"
        for name, kind, least, minutes, risk in (("reads", "read", 3, 60, 0.7), ("failed_logins", "login_failed", 2, 60, 0.8), ("deletions", "delete", 2, 30, 0.9))
    )
)
def burst_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that complete a burst, with thresholds given by the caller."""
    events = table(spark, folder, "audit_events")
    events = events.withColumn("us", micros(events, "ts")).filter("principal_id IS NOT NULL")
    return audit.anomalies(events, "id", "principal_id", "us", F.lower("event_type"), BURSTS)


@query("SELECT m.source_id, m.target_id, count(*) AS rows FROM memory_edges m WHERE m.source_id IS NOT NULL AND m.target_id IS NOT NULL AND (m.source_id IN (SELECT memory_key FROM documents WHERE doc_id % 17 = 0) OR m.target_id IN (SELECT memory_key FROM documents WHERE doc_id % 17 = 0)) GROUP BY 1, 2")
def edges_after_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that are left dangling when some documents are lost."""
    gone = table(spark, folder, "documents").filter("doc_id % 17 = 0").select("memory_key")
    edges = table(spark, folder, "memory_edges").filter("source_id IS NOT NULL AND target_id IS NOT NULL").groupBy("source_id", "target_id").agg(F.count("*").alias("rows"))
    from_gone = edges.join(gone.withColumnRenamed("memory_key", "source_id"), "source_id", "left_semi")
    to_gone = edges.join(gone.withColumnRenamed("memory_key", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("memory_key", "target_id"), "target_id", "left_semi")
    return from_gone.select("source_id", "target_id", "rows").unionByName(to_gone.select("source_id", "target_id", "rows"))


@query("SELECT source, count(*) AS documents, sum(28 + octet_length(encode(text)))::BIGINT AS sealed_bytes, count(DISTINCT doc_id) AS secrets, count(*) AS restored, 0::BIGINT AS opened_after_tampering, 0::BIGINT AS left_readable FROM documents WHERE text IS NOT NULL GROUP BY source")
def sealed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Encrypted documents: the bytes of the secrets (text, vector of 12, tag of 16), how many differ (even those of equal texts), how many come back, and how
    many open although one character was altered or still show their text."""
    given = table(spark, folder, "documents").filter("text IS NOT NULL").select("source", "text", crypto.encrypt(F.col("text"), "first").alias("secret"))
    # the second character stands for bits of the initial vector only
    altered = F.concat(F.left("secret", F.lit(1)), F.translate(F.substring("secret", 2, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "BCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/A"), F.expr("substring(secret, 3)"))
    back, broken = crypto.decrypt(F.col("secret"), "first"), crypto.decrypt(altered, "first")
    shown = (F.length("text") > 8) & F.contains(F.col("secret"), F.col("text"))
    return given.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.length(F.unbase64("secret"))).alias("sealed_bytes"), F.count_distinct("secret").alias("secrets"), F.count_if(back == F.col("text")).alias("restored"), F.count(broken).alias("opened_after_tampering"), F.count_if(shown).alias("left_readable")
    )


@query(
    """WITH t AS (SELECT doc_id, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%H:%M:%S') AS clock, coalesce(source, 'none') AS place FROM documents WHERE created_at IS NOT NULL)
    SELECT doc_id, 'memory:document:' || day || ':' || replace(clock, ':', '-') || ':' || place AS key, day || '|' || CASE WHEN clock LIKE '20:%' THEN replace(clock, ':', '-') ELSE clock END || '|' || place AS parts, day || '_' || clock || '_' || place AS file FROM t"""
)
def memory_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys made of the documents' times, read back, and names of files."""
    made = table(spark, folder, "documents").filter("created_at IS NOT NULL").select("doc_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.date_format("created_at", "HH:mm:ss").alias("clock"), F.coalesce("source", F.lit("none")).alias("place"))
    keyed = made.withColumn("key", paths.key_of(F.lit("document"), F.col("day"), F.col("clock"), F.col("place")))
    path = F.concat(F.lit(".."), F.col("day"), F.lit("/"), F.col("clock"), F.lit("\\"), F.col("place"))
    return keyed.select("doc_id", "key", F.array_join(paths.parts_of(F.col("key")), "|").alias("parts"), paths.file_name(path).alias("file"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'secret|credential|auth') THEN 'secret' WHEN regexp_matches(lower(text), 'private|confidential') THEN 'confidential' WHEN regexp_matches(lower(text), 'internal|workspace') THEN 'internal' ELSE 'public' END AS class,
    len(regexp_extract_all(text, '[A-Za-z0-9+/]{32,}')) > 0 AS sealed_part FROM documents WHERE text IS NOT NULL"""
)
def text_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by words that mark what is kept secret, and whether some part looks encrypted."""
    sealed = F.exists(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{32,}"), F.lit(0)), lambda v: paths.looks_sealed(v))
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", paths.path_class(F.col("text")).alias("class"), sealed.alias("sealed_part"))


@query(
    """WITH d AS (SELECT doc_id, text, lang, source, owner_id, (coalesce(text, '') <> '')::INT + (coalesce(lang, '') <> '')::INT + (coalesce(owner_id, '') <> '')::INT AS filled FROM documents)
    SELECT doc_id, round(least(1.0, filled / 3.0 * 0.4 + CASE WHEN length(coalesce(text, '')) BETWEEN 50 AND 5000 THEN 0.3 WHEN length(coalesce(text, '')) BETWEEN 10 AND 10000 THEN 0.15 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 0.15 ELSE 0 END), 6) AS quality FROM d"""
)
def content_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of documents by filled fields, length, tags and source."""
    quality = scoring.content_quality(("text", "lang", "owner_id"), F.col("text"), F.col("lang").isNotNull(), F.col("source").isNotNull())
    return table(spark, folder, "documents").select("doc_id", F.round(quality, 6).alias("quality"))


_NUMBERED = "regexp_replace(regexp_replace(regexp_replace(text, '(?m)^### ', '2.1.3. ', 'g'), '(?m)^## ', '2.1 ', 'g'), '(?m)^# ', '2. ', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines)))::INT AS nth FROM (SELECT doc_id, string_split({_NUMBERED}, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, nth, CASE WHEN regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\.?\\s+(.+)$') THEN 3 WHEN regexp_matches(line, '^\\d+\\.\\d+\\.?\\s+(.+)$') THEN 2 WHEN regexp_matches(line, '^\\d+\\.\\s+(.+)$') THEN 1 END AS level, rtrim(regexp_extract(line, '^[\\d.]+\\s+(.+)$', 1), chr(13)) AS title FROM l WHERE level IS NOT NULL"""
)
def numbered_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Headings by number of documents whose headings were given numbers."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?m)^### ", "2.1.3. "), r"(?m)^## ", "2.1 "), r"(?m)^# ", "2. ")
    given = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("text"))
    return sections.numbered_headings(given, "doc_id", "text")


@query(
    """SELECT doc_id, unnest([1, 1, 2, 2, 3]) AS level, unnest(['title', 'made', 'made.owner', 'made.place', 'made.place.source']) AS path FROM documents WHERE text IS NOT NULL AND owner_id IS NOT NULL AND source IS NOT NULL
    UNION ALL SELECT doc_id, unnest([1, 1, 2, 2]) AS level, unnest(['title', 'made', 'made.owner', 'made.place']) AS path FROM documents WHERE text IS NOT NULL AND owner_id IS NOT NULL AND source IS NULL
    UNION ALL SELECT doc_id, unnest([1, 1, 2, 3]) AS level, unnest(['title', 'made', 'made.place', 'made.place.source']) AS path FROM documents WHERE text IS NOT NULL AND owner_id IS NULL AND source IS NOT NULL
    UNION ALL SELECT doc_id, unnest([1, 1, 2]) AS level, unnest(['title', 'made', 'made.place']) AS path FROM documents WHERE text IS NOT NULL AND owner_id IS NULL AND source IS NULL"""
)
def nested_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of JSON records made of the documents, as sections; null fields have no key."""
    record = F.to_json(F.struct(F.col("text").alias("title"), F.struct(F.col("owner_id").alias("owner"), F.struct("source").alias("place")).alias("made")))
    given = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", record.alias("record"))
    return sections.nested_sections(given, "doc_id", "record", 4)


@query(
    """WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS turn FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, turn, substr(line, instr(line, ': ') + 2) AS content, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS nth FROM l WHERE regexp_matches(line, '^(user|assistant|system): '))
    SELECT doc_id, count(*) AS messages, substr(string_agg(content, ' ' ORDER BY turn) FILTER (nth <= 3), 1, 200) AS preview FROM m GROUP BY doc_id"""
)
def chat_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Chats with the number of their messages and the beginning of the first three."""
    said = relations.messages(table(spark, folder, "documents"), "doc_id", "text")
    return relations.previews(said, "doc_id")


@query(
    """WITH c AS (SELECT DISTINCT id, doc_id, start_pos, content FROM chunks WHERE doc_id IS NOT NULL),
    w AS (SELECT id, doc_id, start_pos, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) > 5)) AS words FROM c),
    p AS (SELECT id, lead(id) OVER v AS next, words, lead(words) OVER v AS others FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY start_pos NULLS FIRST, id NULLS FIRST)),
    s AS (SELECT id, next, array_to_string(list_sort(list_intersect(words, others))[1:5], ' ') AS shared FROM p) SELECT id, next, shared FROM s WHERE shared <> ''"""
)
def shared_words(spark: SparkSession, folder: str) -> DataFrame:
    """Longer words that each chunk shares with the one behind it."""
    chunks = table(spark, folder, "chunks").select("id", "doc_id", "start_pos", "content").distinct()
    return sections.shared_words(chunks, "doc_id", "start_pos", "id", "content")


@query(
    """WITH c AS (SELECT DISTINCT id, topic, size, nodes FROM memory_clusters WHERE id IS NOT NULL),
    f AS (SELECT id, 'topic' AS field, topic AS value FROM c WHERE topic IS NOT NULL UNION ALL SELECT id, 'size', size::VARCHAR FROM c WHERE size IS NOT NULL UNION ALL SELECT id, 'tag:' || i, nodes[i + 1] FROM (SELECT id, nodes, unnest(range(len(nodes))) AS i FROM c WHERE nodes IS NOT NULL) WHERE nodes[i + 1] IS NOT NULL)
    SELECT id, field, value FROM f"""
)
def flat_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters flattened to fields and values, a tag for each member."""
    given = table(spark, folder, "memory_clusters").filter("id IS NOT NULL").select("id", "topic", "size", "nodes").distinct()
    return merging.flattened(given, "id", ["topic", "size"], "nodes")


@query(f"WITH {_E}, last AS (SELECT memory, max(us) AS us FROM e GROUP BY 1) SELECT e.memory, count(*) AS accesses, max(e.us) AS last_us FROM e JOIN last l ON l.memory = e.memory WHERE e.event_type = 'read' AND e.us > l.us - 30 * 86400000000 GROUP BY 1")
def recent_accesses(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of each memory in the last 30 days before its last event."""
    return merging.recent(_records(spark, folder), "memory", "us", 30, F.col("event_type") == "read")


@query(
    _EACH + """, s AS (SELECT query_id, vec_id, array_cosine_similarity(e, wanted) AS similarity FROM v, q WHERE vec_id <> query_id)
    SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.similarity DESC, vec_id) <= 5"""
)
def near_duplicate_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """At most five other vectors that are as good as the same as each of the query set; in these tables 0.25 is as near as any are."""
    vectors = table(spark, folder, "embeddings")
    near = search.near_duplicates(vectors, "vec_id", "embedding", _wanted(vectors), 0.25)
    return near.select(F.col("query").alias("query_id"), "vec_id", F.round("similarity", 6).alias("similarity"))
