"""Merging records of one memory, as aggregates over their fields: no record list is ever gathered in one place.

Facts are rows (id, memory, us, field, value): one for each field of each record. Records of a memory are ordered by
us, then id. All aggregates combine before the shuffle, so a memory with a third of all records is no hot key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.skew import find_hot, join_unique


def facts(records: DataFrame, id_col: str, memory: str, us: str, fields: Sequence[str]) -> DataFrame:
    """id, memory, us, field, value of records; those without id, memory or time are left out, null values stay."""
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    given = records.filter(F.col(id_col).isNotNull() & F.col(memory).isNotNull() & F.col(us).isNotNull())
    return given.select(F.col(id_col).alias("id"), F.col(memory).alias("memory"), F.col(us).alias("us"), F.explode(entries).alias("fact")).select("id", "memory", "us", "fact.*")


def newest_values(facts: DataFrame) -> DataFrame:
    """memory, field, value: each field as the newest record that has it says; a null never replaces a value."""
    said = facts.filter("value IS NOT NULL")
    return said.groupBy("memory", "field").agg(F.max_by("value", F.struct("us", "id")).alias("value"))


def all_values(facts: DataFrame) -> DataFrame:
    """memory, field, value, times, first_us: all that the records say, each value once, in the order of first_us."""
    said = facts.filter("value IS NOT NULL")
    return said.groupBy("memory", "field", "value").agg(F.count("*").alias("times"), F.min("us").alias("first_us"))


def worth(importance: Column, us: Column, as_of_us: int) -> Column:
    """0.7 importance + 0.3 recency, which falls to 0 over a year, by whole days; a null importance is 0.5."""
    days = F.floor((F.lit(as_of_us) - us) / 86_400_000_000)
    return 0.7 * F.coalesce(importance, F.lit(0.5)) + 0.3 * F.greatest(F.lit(0.0), 1 - days / 365)


def primaries(records: DataFrame, id_col: str, memory: str, us: str, importance: str, as_of_us: int) -> DataFrame:
    """memory, id, worth: the record of each memory that is worth most; of equal ones the one with the smallest id."""
    given = records.filter(F.col(id_col).isNotNull() & F.col(memory).isNotNull() & F.col(us).isNotNull())
    rated = given.select(F.col(id_col).alias("id"), F.col(memory).alias("memory"), F.round(worth(F.col(importance), F.col(us), as_of_us), 9).alias("worth"))
    best = rated.groupBy("memory").agg(F.min(F.struct((-F.col("worth")).alias("less"), "id")).alias("best"))
    return best.select("memory", "best.id", (-F.col("best.less")).alias("worth"))


def additions(facts: DataFrame, primary: DataFrame) -> DataFrame:
    """memory, field, value, times: what other records of a memory say besides its primary one."""
    chosen = facts.join(primary.select("memory", "id"), ["memory", "id"]).select("memory", "field", F.col("value").alias("known"))
    # by value first, so that the join meets each value of a memory once
    return all_values(facts).join(chosen.distinct(), ["memory", "field"], "left").filter(~F.col("value").eqNullSafe(F.col("known"))).select("memory", "field", "value", "times")


def summaries(records: DataFrame, id_col: str, memory: str, us: str) -> DataFrame:
    """One parent per memory and day: memory, day, children, first_us, last_us, first_child, last_child."""
    given = records.filter(F.col(id_col).isNotNull() & F.col(memory).isNotNull() & F.col(us).isNotNull())
    at = given.select(F.col(id_col).alias("id"), F.col(memory).alias("memory"), F.col(us).alias("us"), F.floor(F.col(us) / 86_400_000_000).cast("int").alias("day"))
    order = F.struct("us", "id")
    out = at.groupBy("memory", "day").agg(F.count("*").alias("children"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("id", order).alias("first_child"), F.max_by("id", order).alias("last_child"))
    return out.withColumn("day", F.date_from_unix_date("day"))


def strategies(compared: DataFrame, group: str, relation: str) -> DataFrame:
    """group, pairs, strategy: keep_newest if all pairs are duplicates, else hierarchical if any is temporal, else combine if
    any is a complement, else importance."""
    any_ = lambda kind: F.bool_or(F.col(relation) == kind)
    chosen = F.when(F.bool_and(F.col(relation) == "duplicate"), "keep_newest").when(any_("temporal"), "hierarchical").when(any_("complement"), "combine").otherwise("importance")
    return compared.groupBy(group).agg(F.count("*").alias("pairs"), chosen.alias("strategy"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, field, difference (missing, extra or value) of facts of two tables whose ids are in both."""
    both = left.select("id").distinct().join(right.select("id").distinct(), "id")
    a, b = (df.join(both, "id", "left_semi").select("id", "field", "value", F.lit(True).alias("there")) for df in (left, right))
    joined = a.join(b.withColumnsRenamed({"value": "other", "there": "here"}), ["id", "field"], "full")
    kind = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "extra").when(~F.col("value").eqNullSafe(F.col("other")), "value")
    return joined.select("id", "field", kind.alias("difference")).filter("difference IS NOT NULL")


def patched(records: DataFrame, patches: DataFrame, id_col: str, column: str) -> DataFrame:
    """The records with the entries of their patch (id, patch: map) over those of the map `column`; a null value in a patch
    takes the entry out. Each id has one patch at most."""
    joined = records.join(patches.select(id_col, "patch"), id_col, "left")
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    new = F.coalesce(F.col("patch"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return joined.withColumn(column, F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull() | F.map_contains_key(kept, k))).drop("patch")


def log_entries(events: DataFrame, log: str, us: str, id_col: str) -> DataFrame:
    """Events as entries of append-only logs: log, entry (milliseconds-number), id. The number counts the entries of a log in
    one millisecond, so no more than those meet in one place."""
    ms = F.floor(F.col(us) / 1000)
    nth = F.row_number().over(Window.partitionBy(log, "_ms").orderBy(us, id_col)) - 1
    given = events.filter(F.col(log).isNotNull() & F.col(us).isNotNull()).withColumn("_ms", ms)
    return given.select(F.col(log).alias("log"), F.concat_ws("-", F.col("_ms").cast("string"), nth.cast("string")).alias("entry"), F.col(id_col).alias("id"))


def entry_millis(entry: Column) -> Column:
    """Milliseconds since 1970 of an entry's id, null where it is none."""
    return F.when(entry.rlike(r"^\d+-\d+$"), F.substring_index(entry, "-", 1).try_cast("long"))


def flattened(df: DataFrame, key: str, fields: Sequence[str], tags: str) -> DataFrame:
    """key, field, value: the fields as text, and each member of the list as tag:0, tag:1 and so on; nulls are left out."""
    plain = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    listed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda v, i: F.struct(F.concat(F.lit("tag:"), i.cast("string")).alias("field"), v.alias("value")))
    return df.select(key, F.explode(F.concat(plain, listed)).alias("entry")).select(key, "entry.*").filter("value IS NOT NULL")


def recent(records: DataFrame, memory: str, us: str, days: int, kind: Column) -> DataFrame:
    """memory, accesses, last_us: records of a kind in the last `days` before the last record of their memory. A hot
    memory meets its last time by broadcast."""
    day = 86_400_000_000
    last = records.groupBy(memory).agg(F.max(us).alias("_last"))
    of_kind = records.filter(kind)
    given = join_unique(of_kind, last, memory, find_hot(of_kind, memory), "inner").filter(F.col(us) > F.col("_last") - days * day)
    return given.groupBy(memory).agg(F.count("*").alias("accesses"), F.max(us).alias("last_us"))
