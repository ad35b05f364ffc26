"""Equal and similar texts, and the merging of what is equal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import words
from engram.plans.lineage import Scratch
from engram.plans.skew import find_hot, join_unique

SHINGLE, SIMILAR = 5, 0.8


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """Membership in classes of equal texts: key, digest, class_id (the smallest key), members. Null texts are left out."""
    given = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.sha2(text, 256).alias("digest"))
    classes = given.groupBy("digest").agg(F.min("key").alias("class_id"), F.count("*").alias("members"))
    # the empty text and the like may be a third of all
    return join_unique(given, classes, "digest", find_hot(given, "digest"), "inner").select(F.col("key").alias(key), "digest", "class_id", "members")


def merged(df: DataFrame, key: str, text: str, created: str, label: str) -> DataFrame:
    """One row per text that occurs more than once: newest and oldest key, time range, members, joined labels.

    Ties of the time go to the larger key (newest) or the smaller one (oldest); null times are older than any.
    """
    at = F.struct(F.col(created).alias("t"), F.col(key).alias("k"))
    given = df.filter(F.col(text).isNotNull()).withColumn("digest", F.sha2(text, 256))
    return given.groupBy("digest").agg(
        F.max(at)["k"].alias("newest"), F.min(at)["k"].alias("oldest"), F.min(created).alias("first_at"), F.max(created).alias("last_at"), F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_set(label)), "; ").alias("labels")
    ).filter("members > 1")


def shingle_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and s, the distinct hashes of runs of SHINGLE words; a shorter text is one run of all its words, one without words has no row."""
    hashed = df.select(key, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("_w")).filter(F.size("_w") > 0)
    # the words are a column of their own here: inside the lambda an expression would be computed for every run
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, SHINGLE)))
    return hashed.select(key, F.array_distinct(runs).alias("s"))


def similar_pairs(df: DataFrame, key: str, text: str, least: float = SIMILAR) -> DataFrame:
    """Pairs a < b of different texts whose shingle sets have a Jaccard similarity of at least `least`, exactly.

    Pairs are between class representatives (see exact_groups for the members). Shingles are ordered from rare to
    frequent; two sets as similar as that must share one among the first |x| - ceil(least |x|) + 1 of each, so only
    those are joined on, and pairs whose sizes cannot fit are dropped in the join. Shingles that only one text has are
    never joined. Texts without words have no pairs.
    """
    scratch = Scratch(df.sparkSession)
    first = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_d")).agg(F.min(key).alias("key"))
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(first.select("key"), "key", "left_semi").dropDuplicates(["key"])
    sets = scratch.write(shingle_sets(texts, "key", "text"))
    each = sets.select("key", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("df"))
    ordered = each.join(shared, "h").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
    head = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    prefix = scratch.write(ordered.select("key", "n", F.explode(head).alias("p")).filter("p.df > 1").select("key", "n", F.col("p.h").alias("h")))
    right = prefix.select(F.col("key").alias("key2"), F.col("n").alias("n2"), "h")
    fits = (F.col("key") < F.col("key2")) & (F.col("n") >= F.col("n2") * least - 1e-9) & (F.col("n2") >= F.col("n") * least - 1e-9)
    candidates = prefix.join(right, "h").filter(fits).select("key", "key2").distinct()
    both = candidates.join(sets, "key").join(sets.select(F.col("key").alias("key2"), F.col("s").alias("s2")), "key2")
    common = F.size(F.array_intersect("s", "s2"))
    similarity = common / (F.size("s") + F.size("s2") - common)
    return both.select(F.col("key").alias("a"), F.col("key2").alias("b"), similarity.alias("similarity")).filter(F.col("similarity") >= least)
