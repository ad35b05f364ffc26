"""Queries over the memory store's tables, each with its SQL where SQL can state it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import scoring
from engram.functions.text import TOPIC_STOP_WORDS, fuzzy_words, keyword_score, preview
from engram.operators import audit, chunking, graph, integrity, relations, search, similarity
from engram.sources import store
from engram.sources.tables import micros, table
from engram.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2025-04-01 00:00:00"
WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _score_sql(text: str, query_text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    hits = " + ".join(f"len(list_filter({words}, lambda t: t = '{w}'))" for w in query_text.split())
    return f"CASE WHEN len({words}) > 0 THEN least(1.0, (({hits})::DOUBLE / len({words})) * CASE WHEN contains(lower({text}), '{query_text}') THEN 1.5 ELSE 1.0 END) END"


# --- searches

KEYWORDS = "retention job"
_MATCH = " AND ".join(f"contains(lower(text), '{w}')" for w in KEYWORDS.split())


@query(f"SELECT doc_id, round({_score_sql('text', KEYWORDS)}, 6) AS score FROM documents WHERE {_MATCH}")
def keyword_all_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with all words of a query, with their score."""
    return search.keyword(table(spark, folder, "documents"), "text", KEYWORDS).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH s AS (SELECT doc_id, text, {_score_sql('text', KEYWORDS)} AS score FROM documents WHERE {_MATCH})
    SELECT doc_id, round(score, 6) AS score, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM s ORDER BY s.score DESC, doc_id LIMIT 20"""
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for a query."""
    best = search.keyword(table(spark, folder, "documents"), "text", KEYWORDS).orderBy(F.col("score").desc(), "doc_id").limit(20)
    return best.select("doc_id", F.round("score", 6).alias("score"), preview(F.col("text"), 500).alias("preview"))


@query("SELECT doc_id, instr(text, 'the retention job')::INT AS position FROM documents WHERE contains(text, 'the retention job')")
def exact_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a phrase and where it first occurs."""
    return table(spark, folder, "documents").filter(F.contains("text", F.lit("the retention job"))).select("doc_id", F.instr("text", "the retention job").alias("position"))


FUZZY = "nightly expor pinned memorie"


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"len(list_filter({WORDS_SQL}, lambda t: levenshtein(t, '{w}') <= 1)) > 0" for w in FUZZY.split()))
def fuzzy_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which each query word has a word at an edit distance of at most one."""
    return table(spark, folder, "documents").filter(fuzzy_words(F.col("text"), FUZZY)).select("doc_id")


@query("SELECT doc_id, created_at FROM documents WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2025-01-01' ORDER BY created_at DESC, doc_id LIMIT 10 OFFSET 20")
def time_range_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of a year's documents, newest first."""
    found = search.between(table(spark, folder, "documents"), "created_at", "2024-01-01", "2024-12-31")
    return search.page(found, [F.col("created_at").desc(), F.col("doc_id")], 20, 10).select("doc_id", "created_at")


@query("SELECT doc_id, created_at FROM documents WHERE created_at >= TIMESTAMP '2024-03-01' AND created_at < TIMESTAMP '2024-06-01'")
def time_range_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a range of days."""
    return search.between(table(spark, folder, "documents"), "created_at", "2024-03-01", "2024-05-31").select("doc_id", "created_at")


@query("SELECT rec_id, path FROM checksum_records WHERE regexp_matches(path, '^memory:.*:1.*7$')")
def key_pattern_search(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose key matches a glob."""
    return search.by_pattern(table(spark, folder, "checksum_records"), "path", "memory:*:1*7").select("rec_id", "path")


@query("SELECT id, principal_id, ts FROM audit_events WHERE lower(event_type) = 'delete' AND result <> 'success' AND ts IS NOT NULL ORDER BY ts DESC, id, ingested_at LIMIT 100")
def audit_query(spark: SparkSession, folder: str) -> DataFrame:
    """The latest failed deletions."""
    hit = table(spark, folder, "audit_events").filter("lower(event_type) = 'delete' AND result <> 'success' AND ts IS NOT NULL")
    return hit.orderBy(F.col("ts").desc(), "id", "ingested_at").limit(100).select("id", "principal_id", "ts")


@query("SELECT id, principal_id, risk_score FROM audit_events WHERE ts >= TIMESTAMP '2025-03-05' AND risk_score >= 0.5")
def high_risk_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events since a time with a risk of at least 0.5."""
    return table(spark, folder, "audit_events").filter("ts >= timestamp_ntz'2025-03-05 00:00:00' AND risk_score >= 0.5").select("id", "principal_id", "risk_score")


_VECTORS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))"""


@query(_VECTORS + " SELECT v.vec_id, round(1 - array_cosine_similarity(v.e, q.e), 6) AS distance FROM v, q ORDER BY 1 - array_cosine_similarity(v.e, q.e), v.vec_id LIMIT 10")
def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to the first one."""
    vectors = table(spark, folder, "embeddings")
    wanted = vectors.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query"), F.col("embedding").alias("wanted"))
    return search.nearest(vectors, "vec_id", "embedding", wanted, 10).orderBy("distance", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(_VECTORS + " SELECT v.vec_id, d.source, round(1 - array_cosine_similarity(v.e, q.e), 6) AS distance FROM v JOIN documents d ON d.doc_id = v.vec_id, q WHERE contains(lower(d.text), 'memor') ORDER BY 1 - array_cosine_similarity(v.e, q.e), v.vec_id LIMIT 5")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors whose documents hold a word."""
    vectors = table(spark, folder, "embeddings")
    wanted = vectors.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query"), F.col("embedding").alias("wanted"))
    texts = table(spark, folder, "documents").filter(F.contains(F.lower("text"), F.lit("memor"))).select(F.col("doc_id").alias("vec_id"), "source")
    near = search.nearest(vectors.join(texts, "vec_id", "left_semi"), "vec_id", "embedding", wanted, 5)
    return near.join(texts, "vec_id").select("vec_id", "source", F.round("distance", 6).alias("distance"))


_EACH = "WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS wanted FROM v WHERE vec_id % 100 = 0)"


def _wanted(vectors: DataFrame) -> DataFrame:
    """The query set of a search: every vector whose id is divisible by 100."""
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("wanted"))


@query(
    _EACH + """, s AS (SELECT query_id, vec_id, 1 - array_cosine_similarity(e, wanted) AS distance FROM v, q)
    SELECT query_id, vec_id, round(distance, 6) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.distance, vec_id) <= 10"""
)
def semantic_topk_all(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to each of the query set."""
    vectors = table(spark, folder, "embeddings")
    return search.nearest(vectors, "vec_id", "embedding", _wanted(vectors), 10).select(F.col("query").alias("query_id"), "vec_id", F.round("distance", 6).alias("distance"))


@query(
    _EACH + """, s AS (SELECT query_id, vec_id, source, 1 - array_cosine_similarity(e, wanted) AS distance FROM v JOIN documents d ON d.doc_id = v.vec_id, q WHERE contains(lower(d.text), 'memor'))
    SELECT query_id, vec_id, source, round(distance, 6) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.distance, vec_id) <= 5"""
)
def hybrid_search_all(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors nearest to each of the query set whose documents hold a word."""
    vectors = table(spark, folder, "embeddings")
    texts = table(spark, folder, "documents").filter(F.contains(F.lower("text"), F.lit("memor"))).select(F.col("doc_id").alias("vec_id"), "source")
    near = search.nearest(vectors.join(texts, "vec_id", "left_semi"), "vec_id", "embedding", _wanted(vectors), 5)
    return near.join(texts, "vec_id").select(F.col("query").alias("query_id"), "vec_id", "source", F.round("distance", 6).alias("distance"))


_EDGES = "edges AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight FROM memory_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id AND weight >= 0.7 AND NOT isnan(weight) GROUP BY 1, 2), ways AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.undirected(table(spark, folder, "memory_edges"), "source_id", "target_id", "weight", 0.7)


@query(
    f"""WITH {_EDGES},
    base AS (SELECT memory_key AS node FROM documents WHERE {_MATCH}),
    one AS (SELECT other AS node, weight * 0.8 AS r FROM ways WHERE node IN (SELECT node FROM base) AND weight * 0.8 >= 0.5),
    two AS (SELECT w.other AS node, w.weight * pow(0.8, 2) AS r FROM ways w WHERE w.node IN (SELECT node FROM one) AND w.weight * pow(0.8, 2) >= 0.5),
    reached AS (SELECT node, 1.0 AS r, 0 AS step FROM base UNION ALL SELECT node, r, 1 FROM one UNION ALL SELECT node, r, 2 FROM two),
    best AS (SELECT node, max(r) AS relevance, arg_min(step, (-r, step)) AS step FROM reached GROUP BY node),
    scored AS (SELECT d.doc_id, b.step, b.relevance, coalesce({_score_sql('d.text', KEYWORDS)}, 0) AS keyword,
        CASE WHEN epoch(TIMESTAMP '{AS_OF}' - d.created_at) <= 3600 THEN 0.3 WHEN epoch(TIMESTAMP '{AS_OF}' - d.created_at) <= 86400 THEN 0.2 WHEN epoch(TIMESTAMP '{AS_OF}' - d.created_at) <= 604800 THEN 0.1 ELSE 0.0 END AS boost
        FROM best b JOIN documents d ON d.memory_key = b.node)
    SELECT doc_id, step, round(0.4 * relevance + 0.3 * keyword + 0.2 * CASE WHEN step = 0 THEN 1.0 ELSE relevance END + 0.1 * boost, 6) AS score FROM scored"""
)
def intelligent_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword hits, what is linked to them over two steps, boosted by age and ranked again."""
    documents = table(spark, folder, "documents")
    base = search.keyword(documents, "text", KEYWORDS).select(F.col("memory_key").alias("node"))
    pairs = _pairs(spark, folder)
    ways = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    found = graph.expand(base, ways).withColumnRenamed("node", "memory_key").join(documents, "memory_key")
    age = F.expr(f"timestampdiff(MICROSECOND, created_at, timestamp_ntz'{AS_OF}')") / 1e6
    a, b, c, d = scoring.RERANK_WEIGHTS
    tie = F.when(F.col("step") == 0, 1.0).otherwise(F.col("relevance"))
    score = a * F.col("relevance") + b * F.coalesce(keyword_score(F.col("text"), KEYWORDS), F.lit(0.0)) + c * tie + d * scoring.temporal_boost(age)
    return found.select("doc_id", "step", F.round(score, 6).alias("score"))


@query(
    f"""WITH ranked AS (SELECT id, {_score_sql('content', 'relation edges')} AS score, length(content) // 4 AS tokens FROM chunks WHERE contains(lower(content), 'relation') AND contains(lower(content), 'edges')),
    best AS (SELECT id, score, tokens, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT DISTINCT * FROM ranked)),
    sums AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM best WHERE place <= 10)
    SELECT id, place::INT AS place, tokens::BIGINT AS tokens, before, least(tokens, 300 - before)::BIGINT AS kept FROM sums WHERE before + tokens <= 300 OR (before < 300 AND 300 - before > 100)"""
)
def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The best ten chunks for a query as far as a budget of 300 tokens goes; the one that overflows is cut if more than 100 are left."""
    hits = search.keyword(table(spark, folder, "chunks"), "content", "relation edges").select("id", "score", F.floor(F.length("content") / 4).alias("tokens")).distinct()
    best = hits.orderBy(F.col("score").desc(), "id").limit(10)
    order = Window.orderBy(F.col("score").desc(), "id")  # over the ten rows that are left
    sums = best.withColumn("place", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = sums.filter("before + tokens <= 300 OR (before < 300 AND 300 - before > 100)")
    return kept.select("id", "place", "tokens", "before", F.least("tokens", 300 - F.col("before")).alias("kept"))


# --- equal and similar texts


@query(
    """WITH g AS (SELECT sha256(text) AS digest, min(doc_id) AS class_id, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT d.doc_id, g.digest, g.class_id, g.members FROM documents d JOIN g ON sha256(d.text) = g.digest"""
)
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of equal documents, with every member."""
    return similarity.exact_groups(table(spark, folder, "documents"), "doc_id", "text")


@query(
    """SELECT sha256(text) AS digest, arg_max(doc_id, (created_at, doc_id)) AS newest, arg_min(doc_id, (created_at, doc_id)) AS oldest, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS members,
    coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), '; '), '') AS labels FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""
)
def merge_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per repeated text: newest and oldest document, time range and sources."""
    return similarity.merged(table(spark, folder, "documents"), "doc_id", "text", "created_at", "source")


@query(
    rf"""WITH t AS (SELECT min(doc_id) AS key, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
    s AS (SELECT key, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS h FROM t WHERE len(w) > 0),
    n AS (SELECT key, count(*) AS n FROM s GROUP BY key),
    c AS (SELECT x.key AS a, y.key AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.key < y.key GROUP BY 1, 2)
    SELECT a, b, round(common / (p.n + q.n - common), 6) AS similarity FROM c JOIN n p ON p.key = a JOIN n q ON q.key = b WHERE common / (p.n + q.n - common) >= 0.8"""
)
def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts with a similarity of at least 0.8 on runs of five words; members are in exact_duplicates."""
    return similarity.similar_pairs(table(spark, folder, "documents"), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


_UNITS = (("hour", "yyyy-MM-dd-HH", "%Y-%m-%d-%H"), ("day", "yyyy-MM-dd", "%Y-%m-%d"), ("month", "yyyy-MM", "%Y-%m"))


@query(" UNION ALL ".join(f"SELECT '{u}' AS unit, strftime(created_at, '{s}') AS bucket, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 2" for u, _, s in (*_UNITS, ("week", "", "%Y-%W"))))
def temporal_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per hour, day, week (Monday first, as counted from the year's first Monday) and month."""
    t = F.col("created_at")
    week = F.concat(F.date_format(t, "yyyy"), F.lit("-"), F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0"))
    keys = F.array(*(F.struct(F.lit(u).alias("unit"), F.date_format(t, p).alias("bucket")) for u, p, _ in _UNITS), F.struct(F.lit("week").alias("unit"), week.alias("bucket")))
    return table(spark, folder, "documents").filter(t.isNotNull()).select(F.explode(keys).alias("k")).groupBy("k.unit", "k.bucket").agg(F.count("*").alias("n"))


# --- the graph


@query(f"WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node) SELECT node, degree, round(degree / greatest((SELECT count(*) FROM d) - 1, 1), 6) AS centrality FROM d")
def degree_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """Degree and degree centrality of every memory in a match."""
    return graph.centrality(_pairs(spark, folder)).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node) SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10")
def hub_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories with the most neighbours."""
    return graph.degrees(_pairs(spark, folder)).orderBy(F.col("degree").desc(), "node").limit(10)


@query(f"WITH {_EDGES}, d AS (SELECT node FROM ways GROUP BY node HAVING count(*) = 1) SELECT w.node, w.other AS neighbour FROM ways w JOIN d x ON x.node = w.node JOIN d y ON y.node = w.other")
def isolated_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Memories whose only neighbour has no other neighbour."""
    return graph.lone_pairs(_pairs(spark, folder))


@query(
    f"""WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node),
    t AS (SELECT x.node, count(*) AS triangles FROM ways x JOIN ways y ON x.node = y.node AND x.other < y.other JOIN edges e ON e.a = x.other AND e.b = y.other GROUP BY x.node)
    SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t ON t.node = d.node"""
)
def clustering_coefficient(spark: SparkSession, folder: str) -> DataFrame:
    """Triangles and clustering coefficient of every memory in a match."""
    return graph.clustering(_pairs(spark, folder)).withColumn("coefficient", F.round("coefficient", 6))


@query(f"WITH {_EDGES}, c AS (SELECT (SELECT count(DISTINCT node) FROM ways) AS nodes, (SELECT count(*) FROM edges) AS edges) SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 9) AS density FROM c")
def graph_density(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, edges and density of the graph of matches."""
    return graph.density(_pairs(spark, folder)).withColumn("density", F.round("density", 9))


@query("SELECT edge_type, count(*) AS edges, count(weight) AS weighted, round(avg(confidence), 6) AS confidence FROM memory_edges GROUP BY edge_type")
def edge_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by type."""
    return table(spark, folder, "memory_edges").groupBy("edge_type").agg(F.count("*").alias("edges"), F.count("weight").alias("weighted"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"WITH {_EDGES} SELECT c.id, count(*) AS links FROM (SELECT DISTINCT id, unnest(nodes) AS node FROM memory_clusters) c JOIN ways w ON w.node = c.node JOIN (SELECT DISTINCT id, unnest(nodes) AS node FROM memory_clusters) o ON o.id = c.id AND o.node = w.other GROUP BY c.id")
def cluster_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links, counted from both ends, between the members of each stored cluster."""
    members = table(spark, folder, "memory_clusters").select("id", F.explode("nodes").alias("node")).distinct()
    ways = graph.both_ways(_pairs(spark, folder))
    return members.join(ways, "node").join(members.withColumnRenamed("node", "other"), ["id", "other"]).groupBy("id").agg(F.count("*").alias("links"))


# --- audit


def _events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "audit_events")
    return events.withColumn("us", micros(events, "ts"))


@query(
    " UNION ALL ".join(
        f"SELECT id, principal_id, '{name}' AS pattern, n, {risk}::DOUBLE AS risk FROM (SELECT id, principal_id, count(*) OVER (PARTITION BY principal_id ORDER BY epoch_us(ts) RANGE BETWEEN {minutes * 60_000_000} PRECEDING AND CURRENT ROW) AS n FROM audit_events WHERE lower(event_type) IN ({', '.join(repr(k) for k in kinds)}) AND ts IS NOT NULL) WHERE n >= {threshold}"
        for name, kinds, threshold, minutes, risk in audit.PATTERNS
    )
)
def audit_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Events that complete a burst of their kind by one principal."""
    return audit.anomalies(_events(spark, folder), "id", "principal_id", "us", F.lower("event_type"))


@query("SELECT lower(event_type) AS event_type, count(*) AS events, count(*) FILTER (result <> 'success') AS failures, count(DISTINCT principal_id) AS principals, count(*) FILTER (risk_score >= 0.8) AS high_risk, max(risk_score) AS max_risk FROM audit_events GROUP BY 1")
def compliance_report(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type, with failures, principals and high risk."""
    return audit.by_type(table(spark, folder, "audit_events"), F.lower("event_type"))


@query(
    """WITH l AS (SELECT principal_id, max(epoch_us(ts) * 2 + CASE WHEN lower(event_type) = 'logout' THEN 1 ELSE 0 END) AS last FROM audit_events WHERE lower(event_type) IN ('login', 'logout') AND principal_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
    SELECT principal_id, last // 2 AS since_us FROM l WHERE last % 2 = 0"""
)
def missing_logout(spark: SparkSession, folder: str) -> DataFrame:
    """Principals who are still logged in."""
    return audit.left_logged_in(_events(spark, folder), "principal_id", "us", F.lower("event_type"))


@query("SELECT principal_id, count(*) AS events FROM audit_events a WHERE principal_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM principals p WHERE p.principal_id = a.principal_id AND p.active) GROUP BY 1")
def unauthorized_principals(spark: SparkSession, folder: str) -> DataFrame:
    """Acting principals that are not known and active."""
    known = table(spark, folder, "principals").filter("active").select("principal_id")
    return table(spark, folder, "audit_events").filter("principal_id IS NOT NULL").groupBy("principal_id").agg(F.count("*").alias("events")).join(known, "principal_id", "left_anti")


@query("SELECT resource, count(*) AS events FROM audit_events a WHERE resource IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.memory_key = a.resource) GROUP BY 1")
def orphan_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Resources of events that are no stored document."""
    stored = table(spark, folder, "documents").select(F.col("memory_key").alias("resource"))
    return table(spark, folder, "audit_events").filter("resource IS NOT NULL").groupBy("resource").agg(F.count("*").alias("events")).join(stored, "resource", "left_anti")


@query("SELECT role, count(*) AS principals, count(*) FILTER (active) AS active FROM (SELECT unnest(roles) AS role, active FROM principals) GROUP BY role")
def role_members(spark: SparkSession, folder: str) -> DataFrame:
    """Principals by role."""
    return table(spark, folder, "principals").select(F.explode("roles").alias("role"), "active").groupBy("role").agg(F.count("*").alias("principals"), F.count_if("active").alias("active"))


# --- life cycle

_LIFE = f"""
WITH hits AS (SELECT resource AS memory_key, count(*) FILTER (epoch_us(ts) >= epoch_us(TIMESTAMP '{AS_OF}') - 2592000000000 AND ts < TIMESTAMP '{AS_OF}') AS n, max(ts) FILTER (ts < TIMESTAMP '{AS_OF}') AS last FROM audit_events WHERE resource IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
     cited AS (SELECT target_id AS memory_key, count(DISTINCT source_id) AS refs FROM memory_edges WHERE target_id IS NOT NULL GROUP BY 1),
     parts AS (SELECT d.doc_id, least(1.0, 0.5 * log10(coalesce(h.n, 0) + 1)) AS access, least(1.0, coalesce(c.refs, 0) / 20.0) AS cites, least(1.0, coalesce(length(d.text), 0) / 1000.0) / 2 AS size,
               coalesce(exp(-floor(epoch(TIMESTAMP '{AS_OF}' - coalesce(h.last, d.created_at)) / 86400) / 10), 0) AS fresh FROM documents d LEFT JOIN hits h ON h.memory_key = d.memory_key LEFT JOIN cited c ON c.memory_key = d.memory_key),
     scored AS (SELECT doc_id, access, cites, round((0.25 * access + 0.2 * cites + 0.15 * size + 0.1 * fresh) / (0.25 + 0.2 + 0.15 + 0.1), 6) AS score FROM parts),
     tiered AS (SELECT *, CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.2 THEN 'cold' ELSE 'archive' END AS tier FROM scored),
     lives AS (SELECT doc_id, score, tier, least(floor(CASE tier WHEN 'hot' THEN 365 WHEN 'warm' THEN 90 WHEN 'cold' THEN 30 ELSE 7 END * (CASE WHEN access > 0.5 THEN 1.5 ELSE 1.0 END * CASE WHEN cites > 0.3 THEN 1.3 ELSE 1.0 END)), 1825)::INT AS ttl_days FROM tiered)
"""


def _lives(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).filter("resource IS NOT NULL AND us IS NOT NULL")
    now = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp_ntz'{AS_OF}')")
    past = F.col("us") < now
    hits = events.groupBy(F.col("resource").alias("memory_key")).agg(F.count_if(past & (F.col("us") >= now - 30 * 86_400_000_000)).alias("n"), F.max(F.when(past, F.col("us"))).alias("last"))
    cited = table(spark, folder, "memory_edges").filter("target_id IS NOT NULL").groupBy(F.col("target_id").alias("memory_key")).agg(F.count_distinct("source_id").alias("refs"))
    documents = table(spark, folder, "documents")
    documents = documents.select("doc_id", "memory_key", F.coalesce(F.length("text"), F.lit(0)).alias("size"), micros(documents, "created_at").alias("created"))
    found = documents.join(hits, "memory_key", "left").join(cited, "memory_key", "left")
    access = scoring.access_frequency(F.coalesce("n", F.lit(0)))
    cites = F.least(F.lit(1.0), F.coalesce("refs", F.lit(0)) / 20)
    size = F.least(F.lit(1.0), F.col("size") / 1000) / 2
    parts = found.select("doc_id", access.alias("access"), cites.alias("cites"), size.alias("size"), scoring.recency((now - F.coalesce("last", "created")) / 1e6).alias("fresh"))
    rating = F.lit(None).cast("double")
    score = scoring.weighted([F.col("access"), F.col("cites"), rating, F.col("size"), F.col("fresh")], scoring.IMPORTANCE_WEIGHTS)
    scored = parts.withColumn("score", F.round(score, 6))
    return scored.select("doc_id", "score", scoring.tier(F.col("score")).alias("tier"), scoring.ttl_days(F.col("score"), F.col("access"), F.col("cites"), rating).alias("ttl_days"))


@query(_LIFE + "SELECT doc_id, score, tier, ttl_days FROM lives")
def importance_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Importance, tier and days to live of every document, from accesses, citations, size and age."""
    return _lives(spark, folder)


@query(_LIFE + "SELECT tier, count(*) AS documents, round(avg(score), 4) AS mean_score, max(ttl_days) AS longest FROM lives GROUP BY tier")
def tier_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by tier."""
    return _lives(spark, folder).groupBy("tier").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("ttl_days").alias("longest"))


@query(_LIFE + f"SELECT l.doc_id, l.tier FROM lives l JOIN documents d ON d.doc_id = l.doc_id WHERE epoch(d.created_at) + l.ttl_days * 86400 <= epoch(TIMESTAMP '{AS_OF}')")
def expired_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose time to live is over."""
    documents = table(spark, folder, "documents")
    both = _lives(spark, folder).join(documents.select("doc_id", micros(documents, "created_at").alias("us")), "doc_id")
    now = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp_ntz'{AS_OF}')")
    return both.filter(F.col("us") + F.col("ttl_days").cast("long") * 86_400_000_000 <= now).select("doc_id", "tier")


# --- reports


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, lower(event_type) AS event_type, count(*) AS n FROM audit_events WHERE ts IS NOT NULL GROUP BY 1, 2")
def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type."""
    return table(spark, folder, "audit_events").filter("ts IS NOT NULL").groupBy(F.col("ts").cast("date").cast("string").alias("day"), F.lower("event_type").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT hour(ts)::INT AS hour, ((dayofweek(ts) + 6) % 7)::INT AS weekday, count(*) AS n FROM audit_events WHERE ts IS NOT NULL GROUP BY 1, 2")
def active_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and weekday (Monday is 0)."""
    return table(spark, folder, "audit_events").filter("ts IS NOT NULL").groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT lower(event_type) AS event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM audit_events WHERE ts IS NOT NULL GROUP BY 1, 2), m AS (SELECT max(day) AS last FROM d),
    a AS (SELECT event_type, avg(n) FILTER (day > last - 7) AS recent, avg(n) FILTER (day <= last - 7) AS older FROM d, m GROUP BY 1)
    SELECT event_type, round(recent, 6) AS recent, round(older, 6) AS older, CASE WHEN older IS NULL OR recent IS NULL THEN 'unknown' WHEN recent > older * 1.2 THEN 'up' WHEN recent < older * 0.8 THEN 'down' ELSE 'steady' END AS trend FROM a"""
)
def activity_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Mean events per day of the last week against before, by type."""
    days = table(spark, folder, "audit_events").filter("ts IS NOT NULL").groupBy(F.lower("event_type").alias("event_type"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    both = days.crossJoin(F.broadcast(days.agg(F.max("day").alias("last"))))
    late = F.col("day") > F.date_sub("last", 7)
    means = both.groupBy("event_type").agg(F.avg(F.when(late, F.col("n"))).alias("recent"), F.avg(F.when(~late, F.col("n"))).alias("older"))
    trend = F.when(F.col("older").isNull() | F.col("recent").isNull(), "unknown").when(F.col("recent") > F.col("older") * 1.2, "up").when(F.col("recent") < F.col("older") * 0.8, "down").otherwise("steady")
    return means.select("event_type", F.round("recent", 6).alias("recent"), F.round("older", 6).alias("older"), trend.alias("trend"))


@query(
    f"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents WHERE text IS NOT NULL),
    c AS (SELECT source, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in TOPIC_STOP_WORDS)}) GROUP BY 1, 2)
    SELECT source, word, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM c) WHERE place <= 3"""
)
def topic_words(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent words of each source."""
    every = table(spark, folder, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    counts = every.filter(~F.col("word").isin(*TOPIC_STOP_WORDS)).groupBy("source", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "word"))).filter("place <= 3")


@query("SELECT algorithm, verify_state, count(*) AS records, sum(size_bytes)::BIGINT AS total, min(size_bytes) AS smallest, max(size_bytes) AS largest, round(avg(size_bytes), 6) AS mean FROM checksum_records GROUP BY 1, 2")
def integrity_report(spark: SparkSession, folder: str) -> DataFrame:
    """Checksum records by algorithm and state."""
    s = "size_bytes"
    return table(spark, folder, "checksum_records").groupBy("algorithm", "verify_state").agg(F.count("*").alias("records"), F.sum(s).alias("total"), F.min(s).alias("smallest"), F.max(s).alias("largest"), F.round(F.avg(s), 6).alias("mean"))


@query("SELECT chunk_type, count(*) AS chunks, floor(avg(char_count))::BIGINT AS mean_chars, min(char_count) AS shortest, max(char_count) AS longest, count(*) FILTER (section_path IS NOT NULL) AS structured FROM chunks GROUP BY 1")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chunks by type."""
    return table(spark, folder, "chunks").groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.floor(F.avg("char_count")).alias("mean_chars"), F.min("char_count").alias("shortest"), F.max("char_count").alias("longest"), F.count("section_path").alias("structured"))


# --- relations, chats and chunks


@query(
    """WITH n AS (SELECT doc_id, id, coalesce(section_level, 0) AS level, lead(id) OVER w AS next_id, lead(coalesce(section_level, 0)) OVER w AS next_level FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos NULLS FIRST, id))
    SELECT doc_id, id AS chunk_id, next_id FROM n WHERE next_id IS NOT NULL AND abs(level - next_level) <= 1"""
)
def sequential_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk after each chunk."""
    return relations.sequence(table(spark, folder, "chunks"))


@query("SELECT doc_id, array_to_string(section_path, ' > ') AS path, count(*) AS members, min(id) AS first_id, max(id) AS last_id FROM chunks WHERE section_path IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def sibling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks under the same section."""
    return relations.siblings(table(spark, folder, "chunks"))


@query("SELECT id, ref, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, 'memory:[a-z]+:[0-9]+')) AS ref FROM chunks WHERE content IS NOT NULL) GROUP BY 1, 2")
def reference_links(spark: SparkSession, folder: str) -> DataFrame:
    """Memory keys that chunks name."""
    return relations.references(table(spark, folder, "chunks"), "id", "content")


@query(
    r"""WITH e AS (SELECT id, unnest(regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+ [A-Z][a-z]+)', 1)) AS entity FROM chunks WHERE content IS NOT NULL)
    SELECT entity, count(DISTINCT coalesce(id, '')) AS rows_with, count(*) AS mentions FROM e GROUP BY entity HAVING count(DISTINCT coalesce(id, '')) >= 3"""
)
def important_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Capitalised pairs of words that at least three chunks hold."""
    return relations.entities(table(spark, folder, "chunks"), "id", "content")


_SAID = """said AS (SELECT doc_id, turn, split_part(line, ': ', 1) AS role, substr(line, instr(line, ': ') + 2) AS content FROM
    (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS turn FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(line, '^(user|assistant|system): '))"""


@query(f"WITH {_SAID} SELECT role, count(*) AS messages, sum(length(content))::BIGINT AS chars FROM said GROUP BY role")
def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by role in all chats."""
    return relations.messages(table(spark, folder, "documents"), "doc_id", "text").groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("chars"))


@query(
    f"""WITH {_SAID}, b AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY turn) AS before, sum((role = 'user')::INT) OVER (PARTITION BY doc_id ORDER BY turn) AS users FROM said),
    s AS (SELECT *, sum((role = 'user' AND (before = 'assistant' OR users = 1))::INT) OVER (PARTITION BY doc_id ORDER BY turn)::BIGINT AS session FROM b)
    SELECT doc_id, session, min(turn)::INT AS first_turn, count(*) AS messages FROM s WHERE session > 0 GROUP BY 1, 2"""
)
def conversation_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Question and answer sessions of chats."""
    return relations.chat_sessions(relations.messages(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@query(
    """WITH p AS (SELECT doc_id, lag(doc_id) OVER w AS before, epoch_us(created_at) - lag(epoch_us(created_at)) OVER w AS gap FROM documents WHERE created_at IS NOT NULL WINDOW w AS (ORDER BY created_at, doc_id))
    SELECT doc_id, before, round(1 - gap / 3600000000, 6) AS proximity FROM p WHERE gap <= 3600000000"""
)
def temporal_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The document made before each one, if within an hour."""
    documents = table(spark, folder, "documents")
    near = search.neighbours_in_time(documents.select("doc_id", micros(documents, "created_at").alias("us")), "doc_id", "us", 3_600_000_000)
    return near.withColumn("proximity", F.round("proximity", 6))


def _chunked(strategy: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return chunking.chunk(table(spark, folder, "documents"), "doc_id", "text", strategy)

    run.__name__ = f"chunks_{strategy}"
    run.__doc__ = f"Documents cut into chunks: {strategy}."
    return run


for _strategy in chunking.STRATEGIES:
    query()(_chunked(_strategy))


# --- integrity and migration


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text))::INT AS size_bytes FROM documents WHERE text IS NOT NULL")
def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Checksums and sizes of all documents."""
    return integrity.manifest(table(spark, folder, "documents"), "doc_id", "text")


@query("SELECT checksum, count(DISTINCT path) AS paths FROM checksum_records WHERE checksum IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1")
def checksum_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Checksums that several paths share."""
    return table(spark, folder, "checksum_records").filter("checksum IS NOT NULL").groupBy("checksum").agg(F.count_distinct("path").alias("paths")).filter("paths > 1")


_BY_LENGTH = "CASE WHEN regexp_matches(checksum, '^[0-9a-fA-F]+$') THEN CASE length(checksum) " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in integrity.ALGORITHMS) + " END END"


@query(f"SELECT algorithm, {_BY_LENGTH} AS guessed, count(*) AS records FROM checksum_records GROUP BY 1, 2")
def guessed_algorithms(spark: SparkSession, folder: str) -> DataFrame:
    """Algorithms as given and as the digest's length tells."""
    return table(spark, folder, "checksum_records").groupBy("algorithm", integrity.algorithm_of(F.col("checksum")).alias("guessed")).agg(F.count("*").alias("records"))


_PII_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN '{name}' END" for name, p in integrity.PII_PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',')"


def _any_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


@query(
    f"""WITH s AS (SELECT id, {_PII_SQL} AS pii, {_any_sql(integrity.SENSITIVE_WORDS)} AS sensitive, {_any_sql(integrity.MEDICAL_WORDS)} AS medical, {_any_sql(integrity.FINANCE_WORDS)} AS finance FROM chunk_data WHERE content IS NOT NULL)
    SELECT *, CASE WHEN pii <> '' THEN 'pii' WHEN sensitive THEN 'confidential' ELSE 'public' END AS level FROM s"""
)
def sensitivity_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Sensitivity of chunks by patterns and words."""
    given = table(spark, folder, "chunk_data").filter("content IS NOT NULL").select("id", "content")
    return integrity.sensitivity(given, "content").drop("content")


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN text || ' ' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -doc_id - 1, text FROM documents WHERE doc_id % 19 = 0)
    SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra' WHEN coalesce(s.text, '') = coalesce(t.text, '') THEN 'match' ELSE 'mismatch' END AS status FROM documents s FULL JOIN t ON s.doc_id = t.doc_id"""
)
def migration_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against a copy with missing, altered and extra rows."""
    source = table(spark, folder, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    target = source.filter("doc_id % 17 <> 0").select("doc_id", changed.alias("text")).unionByName(source.filter("doc_id % 19 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return integrity.differences(source, target, "doc_id", "text")


_RULES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS rule, '{severity}' AS severity FROM documents WHERE NOT coalesce({sql}, false)"
    for name, sql, severity in (("has_text", "trim(text) <> ''", "error"), ("size_known", "n_chars = length(text)", "error"), ("has_source", "source IS NOT NULL", "warning"), ("has_owner", "owner_id IS NOT NULL", "warning"), ("dated", "created_at IS NOT NULL", "error"))
)


@query(_RULES_SQL)
def broken_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that documents break."""
    rules = {
        "has_text": (F.trim("text") != "", "error"),
        "size_known": (F.col("n_chars") == F.length("text"), "error"),
        "has_source": (F.col("source").isNotNull(), "warning"),
        "has_owner": (F.col("owner_id").isNotNull(), "warning"),
        "dated": (F.col("created_at").isNotNull(), "error"),
    }
    return integrity.broken_rules(table(spark, folder, "documents"), "doc_id", rules)


@query("SELECT event_type, count(*) AS events, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    """A number inside the events' JSON, summed by type."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT split_part(path, ':', 2) AS kind, count(*) AS records, count(DISTINCT split_part(path, ':', 3)) AS ids FROM checksum_records WHERE len(string_split(path, ':')) >= 3 GROUP BY 1")
def key_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the kind in their key."""
    parts = F.split("path", ":")
    return table(spark, folder, "checksum_records").filter(F.size(parts) >= 3).groupBy(parts[1].alias("kind")).agg(F.count("*").alias("records"), F.count_distinct(parts[2]).alias("ids"))


@query("SELECT doc_id, strftime(created_at, '%Y-%m-%d/%H:%M:%S.%g') || coalesce('/' || source, '') AS path FROM documents WHERE created_at IS NOT NULL")
def time_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths made of date, time and source."""
    return table(spark, folder, "documents").filter("created_at IS NOT NULL").select("doc_id", F.concat_ws("/", F.date_format("created_at", "yyyy-MM-dd"), F.date_format("created_at", "HH:mm:ss.SSS"), "source").alias("path"))


# --- the store and streams


@query("SELECT wire_id, event_type, received_at FROM (SELECT *, row_number() OVER (PARTITION BY wire_id ORDER BY received_at DESC NULLS LAST, event_type DESC NULLS LAST) AS place FROM audit_wire) WHERE place = 1")
def newest_records(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every record."""
    return store.newest(table(spark, folder, "audit_wire").select("wire_id", "event_type", "received_at"), ["wire_id"], ["received_at"])


@query("SELECT rec_id, path, coalesce(verify_state, 'new') AS verify_state FROM (SELECT DISTINCT rec_id, path, verify_state FROM checksum_records) WHERE verify_state IS NULL OR verify_state = 'ok' UNION ALL SELECT rec_id, path, 'again' FROM (SELECT DISTINCT rec_id, path, verify_state FROM checksum_records) WHERE verify_state NOT IN ('ok')")
def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Records after an upsert of those that were not verified."""
    old = table(spark, folder, "checksum_records").select("rec_id", "path", "verify_state").distinct()
    new = old.filter("verify_state <> 'ok'").withColumn("verify_state", F.lit("again"))
    return store.upsert(old, new, ["rec_id"]).withColumn("verify_state", F.coalesce("verify_state", F.lit("new")))


@query("SELECT date_trunc('hour', ts) AS hour, lower(event_type) AS kind, count(*) AS events FROM audit_events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events per hour and type, from a stream."""
    counted = streams.hourly(streams.source(spark, f"{folder}/audit_events.parquet"), "ts", "event_type")
    return streams.finished(counted, ["w", "kind"]).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "kind", "events")


@query(
    """WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN gap < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
    SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, run"""
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sessions, from a stream."""
    given = streams.source(spark, f"{folder}/events.parquet").select("user_id", "ts").filter("ts IS NOT NULL")
    found = streams.closed(given, lambda events: streams.user_sessions(events, "user_id", "ts"), "ts")
    return found.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "events")


@query(
    """WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN gap < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g),
    t AS (SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, run)
    SELECT * FROM t WHERE epoch_us(last_at) + 1800000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 2 * 86400000000"""
)
def stream_closed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sessions that a watermark of two days has closed, from a stream."""
    given = streams.source(spark, f"{folder}/events.parquet").select("user_id", "ts").filter("ts IS NOT NULL")
    found = streams.closed(given, lambda events: streams.user_sessions(events, "user_id", "ts"), "ts", flush=False)
    return found.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "events")
