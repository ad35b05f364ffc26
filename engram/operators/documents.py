"""What kind of document a text is, its outline, its category, and the sentences that answer a query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line patterns of markdown (any is enough) and of code (three are needed). Lines end with a line feed only.
MARKDOWN = (r"^#{1,6}\s+", r"\[.+\]\(.+\)", r"^```", r"^\*{1,2}.+\*{1,2}", r"^_{1,2}.+_{1,2}")
CODE = (r"^\s*(def|class|function|const|let|var)\s+", r"^\s*(import|from|require)\s+", r"[{};]\s*$", r"^\s*(if|for|while|switch)\s*\(", r"^\s*return\s+", r"^\s*pass\s*$")
# Categories and the words that speak for them; of equals, the first.
CATEGORIES = {
    "work": ("업무", "work", "job", "task", "project", "회의", "meeting", "프로젝트", "작업"),
    "personal": ("개인", "personal", "private", "일상", "daily"),
    "study": ("공부", "study", "learn", "학습", "교육", "education", "배운", "배움"),
    "idea": ("아이디어", "idea", "생각", "thought", "계획", "plan"),
    "reference": ("참고", "reference", "링크", "link", "url", "자료"),
}


def kind(text: Column) -> Column:
    """markdown, code or plain; null text gives null."""
    lines = lambda p: text.rlike("(?md)" + p)
    markdown = F.lit(False)
    for p in MARKDOWN:
        markdown = markdown | lines(p)
    code = sum((lines(p).cast("int") for p in CODE), F.lit(0))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(markdown, "markdown").when(code >= 3, "code").otherwise("plain")


def with_category(df: DataFrame, text: str, out: str = "category") -> DataFrame:
    """Add the category with the most of its words in the text, or general; null text gives null.

    The words found are a column of their own, so that a text is searched once for each.
    """
    low = df.withColumn("_low", F.lower(text))
    scores = [sum((F.contains("_low", F.lit(w)).cast("int") for w in words), F.lit(0)) for words in CATEGORIES.values()]
    scored = low.withColumn("_scores", F.array(*scores))
    best = F.array_max("_scores")
    name = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.array_position("_scores", best).cast("int"))
    return scored.withColumn(out, F.when(F.col(text).isNotNull(), F.when(best == 0, "general").otherwise(name))).drop("_low", "_scores")


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """Headings of each text in order: key, nth line, level, entry (indented by level)."""
    lines = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("nth", "line"))
    heads = lines.filter(F.col("line").rlike("^#{1,6} ")).withColumn("level", F.length(F.substring_index("line", " ", 1)))
    title = F.trim(F.expr("substring(line, level + 2)"))
    return heads.select(F.col("key").alias(key), "nth", "level", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), title).alias("entry"))


def answer(text: Column, query: str, most: int | None = 500) -> Column:
    """Sentences of the text that hold a query word, joined, at most so many characters (None: all); empty if there are none."""
    terms = query.lower().split()

    def hit(sentence: Column) -> Column:
        out = F.lit(False)
        for w in terms:
            out = out | F.contains(F.lower(sentence), F.lit(w))
        return out

    said = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), hit)
    whole = F.array_join(said, ". ")
    return whole if most is None else F.substring(whole, 1, most)
