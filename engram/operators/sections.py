"""Parts of structured texts: code blocks, tables, sections with their extent, and what surrounds a chunk."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"
TABLE_LINE = r"^\s*\|.*\|\s*$"


def code_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, nth, language, code of fenced blocks; an unclosed fence opens none. The language may be empty."""
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(FENCE), F.lit(1)).alias("language"), F.regexp_extract_all(F.col(text), F.lit(FENCE), F.lit(2)).alias("code"))
    return df.select(key, F.posexplode(both).alias("nth", "block")).select(key, "nth", "block.language", "block.code")


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, first (the line on which it begins), lines, columns of each run of two table lines or more."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("nth", "line")).filter(F.col("line").rlike(TABLE_LINE))
    # lines of a run share their number less their place among the table lines of the text
    place = F.row_number().over(Window.partitionBy(key).orderBy("nth"))
    runs = lines.withColumn("run", F.col("nth") - place).groupBy(key, "run")
    width = F.size(F.split(F.trim("line"), r"\|")) - 2
    return runs.agg(F.min("nth").alias("first"), F.count("*").alias("lines"), F.max(width).alias("columns")).filter("lines >= 2").drop("run")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, end, level, title of markdown sections; a section ends where one of its level or a higher one begins.

    Each text's headings are walked within the text's own row.
    """
    marks = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(r"\n(#{1,6} [^\n]*)"), F.lit(1))
    # where the nth heading stands: behind all text before it, which is split off at the headings
    between = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n#{1,6} [^\n]*")
    listed = df.select(key, F.length(text).alias("whole"), F.posexplode(F.arrays_zip(marks.alias("mark"), between.alias("before"))).alias("nth", "part"))
    back = Window.partitionBy(key).orderBy("nth")
    upto = F.sum(F.length("part.before") + F.coalesce(F.length("part.mark") + 1, F.lit(0))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    placed = listed.filter("part.mark IS NOT NULL").select(key, "whole", "nth", F.col("part.mark").alias("mark"), (F.coalesce(upto, F.lit(0)) + F.length("part.before")).cast("int").alias("start"))
    level = F.length(F.substring_index("mark", " ", 1))
    levelled = placed.select(key, "whole", "nth", "start", level.alias("level"), F.trim(F.expr("substring(mark, length(substring_index(mark, ' ', 1)) + 2)")).alias("title"))
    ahead = back.rowsBetween(1, Window.unboundedFollowing)
    higher = [F.min(F.when(F.col("level") <= k, F.col("start"))).over(ahead) for k in range(1, 7)]
    ends = F.coalesce(F.element_at(F.array(*higher), F.col("level")), F.col("whole"))
    return levelled.select(key, "start", ends.alias("end"), "level", "title")


def deepest(sections: DataFrame, offsets: DataFrame, key: str, offset: str) -> DataFrame:
    """Each row of `offsets` with the level and title of the deepest section that holds its offset, if any does."""
    hit = offsets.join(sections, key).filter((F.col("start") <= F.col(offset)) & (F.col(offset) < F.col("end")))
    return hit.groupBy(*offsets.columns).agg(F.max(F.struct("level", "start", "title")).alias("_best")).select(*offsets.columns, "_best.level", "_best.title")


def surroundings(chunks: DataFrame, doc: str, start: str, id_col: str, content: str, width: int = 100) -> DataFrame:
    """id with the last `width` characters of the chunk before and the first of the one behind, trimmed; null at the ends of a
    document. Chunks of one document meet in one place, no more."""
    order = Window.partitionBy(doc).orderBy(start, id_col)
    given = chunks.filter(F.col(doc).isNotNull())
    before, behind = F.lag(F.right(F.col(content), F.lit(width))).over(order), F.lead(F.left(F.col(content), F.lit(width))).over(order)
    return given.select(F.col(id_col).alias("id"), F.trim(before).alias("before"), F.trim(behind).alias("behind"))

# Headings by number and their level.
NUMBERED = ((r"^\d+\.\d+\.\d+\.?\s+(.+)$", 3), (r"^\d+\.\d+\.?\s+(.+)$", 2), (r"^\d+\.\s+(.+)$", 1))
# Words that two chunks share without a meaning.
COMMON_WORDS = ("the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for")


def numbered_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, nth line, level, title of headings by number (1., 1.1., 1.1.1.)."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("nth", "line"))
    level, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, n in reversed(NUMBERED):
        level = F.when(F.col("line").rlike(pattern), n).otherwise(level)
        title = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).otherwise(title)
    return lines.select(key, "nth", level.alias("level"), title.alias("title")).filter("level IS NOT NULL")


def nested_sections(df: DataFrame, key: str, content: str, deepest: int = 6) -> DataFrame:
    """key, level, path of the keys of JSON objects and of objects in them, to `deepest` levels; keys are letters, digits and _."""
    at = df.select(key, F.lit("$").alias("path"), F.col(content).alias("body"), F.lit(0).alias("level"))
    out = None
    for _ in range(deepest):
        found = at.filter(F.ltrim("body").startswith("{")).select(key, "path", "body", "level", F.explode(F.json_object_keys("body")).alias("name"))
        at = found.select(key, F.concat("path", F.lit("."), "name").alias("path"), F.expr("get_json_object(body, concat('$.', name))").alias("body"), (F.col("level") + 1).alias("level"))
        out = at if out is None else out.unionByName(at)
    return out.select(key, "level", F.expr("substring(path, 3)").alias("path"))


def shared_words(chunks: DataFrame, doc: str, start: str, id_col: str, content: str, most: int = 5) -> DataFrame:
    """id, next, shared: for each chunk and the one behind it in its document the longer words (six letters and more) that both
    have, the first `most` in order of spelling; pairs without any are left out."""
    order = Window.partitionBy(doc).orderBy(start, id_col)
    own = F.filter(F.array_distinct(F.split(F.lower(content), r"\s+")), lambda w: (F.length(w) > 5) & ~w.isin(*COMMON_WORDS))
    given = chunks.filter(F.col(doc).isNotNull()).select(doc, start, F.col(id_col).alias("id"), own.alias("words"))
    paired = given.select("id", F.lead("id").over(order.orderBy(start, "id")).alias("next"), "words", F.lead("words").over(order.orderBy(start, "id")).alias("others"))
    shared = F.slice(F.sort_array(F.array_intersect("words", "others")), 1, most)
    return paired.select("id", "next", F.array_join(shared, " ").alias("shared")).filter("shared <> ''")
