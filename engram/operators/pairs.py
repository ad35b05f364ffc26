"""How similar two linked memories are, by text, structure, time and metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch
from engram.plans.skew import HOT_FLOOR, hot_keys, join_unique

from engram.functions.scoring import nearness
from engram.functions.text import content_words

# Shares of content, structure, time and metadata.
WEIGHTS = (0.5, 0.2, 0.1, 0.2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))


def same_places(a: Column, b: Column) -> Column:
    """Share of positions at which two texts have the same character, of the longer one; 0 if one is empty."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(same / longest)


def relation(overall: Column, text: Column, structure: Column, time: Column) -> Column:
    """What two memories are to each other; the first rule that holds."""
    out = F.when(overall >= 0.95, "duplicate").when((time >= 0.7) & (text < 0.5), "temporal").when((structure >= 0.8) & (text < 0.5), "structural")
    return out.when((overall >= 0.4) & (overall < 0.7) & (time >= 0.5), "complement").otherwise("similar")


def compare(pairs: DataFrame, memories: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of memories (key, text, us, source) that both exist, with their similarities and relation.

    places compares whole texts, or their first `most` characters if that is given. Words are taken once per memory, before
    the joins. A null text counts as empty, an unknown time as far away. The keys of memories are unique. Pairs are written when
    this is called.
    """
    side = memories.select("key", F.coalesce("text", F.lit("")).alias("text"), "us", "source").withColumn("words", content_words(F.col("text")))
    left = side.select(*[F.col(c).alias({"key": "a"}.get(c, f"{c}_a")) for c in side.columns])
    right = side.select(*[F.col(c).alias({"key": "b"}.get(c, f"{c}_b")) for c in side.columns])
    scratch = Scratch(pairs.sparkSession)
    both, seen = scratch.counted(pairs.select("a", "b"))
    # a hub's memory meets its pairs by broadcast; hubs are few, as they are hot
    for end, memory in (("a", left), ("b", right)):
        links = scratch.write(both.groupBy(end).agg(F.count("*").alias("n"))) if seen["n"] > HOT_FLOOR else None
        both = join_unique(both, memory, end, None if links is None else hot_keys(links, end, "n", seen["n"]), "inner")
    begin = [F.col(c) if most is None else F.substring(c, 1, most) for c in ("text_a", "text_b")]
    both = both.withColumns({
        "content": jaccard(F.col("words_a"), F.col("words_b")),
        "structure": (F.col("text_a") == F.col("text_b")).cast("double"),
        "time": F.coalesce(nearness((F.col("us_a") - F.col("us_b")) / 1e6), F.lit(0.0)),
        "metadata": F.coalesce((F.col("source_a") == F.col("source_b")).cast("double"), F.lit(0.5)),
        "places": same_places(*begin),
    })
    w = WEIGHTS
    both = both.withColumn("overall", w[0] * F.col("content") + w[1] * F.col("structure") + w[2] * F.col("time") + w[3] * F.col("metadata"))
    return both.select("a", "b", "content", "time", "places", "overall", relation(F.col("overall"), F.col("content"), F.col("structure"), F.col("time")).alias("relation"))
