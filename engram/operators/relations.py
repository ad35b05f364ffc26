"""Relations between chunks, messages and documents."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REFERENCE = r"memory:[a-z]+:[0-9]+"
#: Pairs of capitalised words stand for entities; what precedes must be no letter, digit or underscore.
ENTITY = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+ [A-Z][a-z]+)"


def sequence(chunks: DataFrame) -> DataFrame:
    """The chunk that follows each one in its document, if their levels differ by at most one; a null level counts as 0."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "id")
    following = chunks.select("doc_id", "id", "start_pos", F.coalesce("section_level", F.lit(0)).alias("level")).withColumns({"next_id": F.lead("id").over(w), "next_level": F.lead("level").over(w)})
    return following.filter("next_id IS NOT NULL AND abs(level - next_level) <= 1").select("doc_id", F.col("id").alias("chunk_id"), "next_id")


def siblings(chunks: DataFrame) -> DataFrame:
    """Chunks of a document under the same section path, as classes: doc_id, path, members, first and last id."""
    path = F.array_join("section_path", " > ")
    return chunks.filter("section_path IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", path.alias("path")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("members > 1")


def references(df: DataFrame, key: str, text: str, pattern: str = REFERENCE) -> DataFrame:
    """Memory keys that a text names: key, ref, n."""
    named = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), 1)).alias("ref"))
    return named.groupBy("key", "ref").agg(F.count("*").alias("n")).withColumnRenamed("key", key)


def entities(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Entities that occur in at least so many different rows: entity, rows_with, mentions."""
    named = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), 1)).alias("entity"))
    return named.groupBy("entity", "key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("rows_with"), F.sum("n").alias("mentions")).filter(F.col("rows_with") >= least)


def messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Messages of chats whose lines begin with a role: key, turn, role, content. Other lines are left out."""
    lines = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("turn", "line"))
    said = lines.filter(F.col("line").rlike("^(user|assistant|system): "))
    return said.select(F.col("key").alias(key), "turn", F.substring_index("line", ": ", 1).alias("role"), F.expr("substring(line, instr(line, ': ') + 2)").alias("content"))


def previews(said: DataFrame, key: str, first: int = 3, length: int = 200) -> DataFrame:
    """key, messages, preview: the first messages of a chat, joined and cut."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("turn"))
    numbered = said.withColumn("nth", nth)
    early = F.transform(F.sort_array(F.collect_list(F.when(F.col("nth") <= first, F.struct("nth", "content")))), lambda m: m["content"])
    return numbered.groupBy(key).agg(F.count("*").alias("messages"), F.substring(F.array_join(early, " "), 1, length).alias("preview"))


def chat_sessions(said: DataFrame, key: str) -> DataFrame:
    """Sessions of a chat: one begins at the first user message and at each that follows an assistant's.

    key, session, first_turn, messages; what comes before the first session is left out.
    """
    w = Window.partitionBy(key).orderBy("turn")
    before = F.lag("role").over(w)
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begins = (F.col("role") == "user") & ((before == "assistant") | (users == 1))
    numbered = said.withColumn("_begins", begins).withColumn("session", F.sum(F.col("_begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.filter("session > 0").groupBy(key, "session").agg(F.min("turn").alias("first_turn"), F.count("*").alias("messages"))


def parents(chunks: DataFrame) -> DataFrame:
    """The first chunk (smallest id) of the section above each chunk's: doc_id, chunk_id, parent_id. Repeated rows count once."""
    n = F.size("section_path")
    up = F.when(n > 1, F.array_join(F.slice("section_path", 1, F.greatest(n - 1, F.lit(1))), " > ")).otherwise("")
    paths = chunks.filter("doc_id IS NOT NULL AND section_path IS NOT NULL").select("id", "doc_id", F.array_join("section_path", " > ").alias("path"), up.alias("up")).distinct()
    heads = paths.groupBy("doc_id", F.col("path").alias("up")).agg(F.min("id").alias("parent_id"))
    return paths.filter("up <> ''").join(heads, ["doc_id", "up"]).select("doc_id", F.col("id").alias("chunk_id"), "parent_id")
