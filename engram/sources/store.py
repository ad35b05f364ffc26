"""Keyed records as tables: upsert, append, delete, expiry and snapshots, without changing a table in place."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import glob_regex


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`, then by the other columns; null orders are older than any."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key has no new row, and the new rows."""
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete(df: DataFrame, key: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes of the rows whose key matches a glob; null keys stay."""
    hit = F.coalesce(F.col(key).rlike(glob_regex(pattern)), F.lit(False))
    return df.filter(~hit), df.filter(hit)


def alive(df: DataFrame, updated: str, ttl_seconds: Column, as_of: Column) -> DataFrame:
    """Rows that have not expired; without a time to live they never do."""
    ends = F.unix_seconds(F.col(updated).cast("timestamp")) + ttl_seconds
    return df.filter(ttl_seconds.isNull() | (ends > as_of))


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table whole and put it in the place of the old one by renaming folders.

    A reader that begins between the two renames finds no table, and where a rename is a copy (object stores) that takes its
    time; a rename that fails raises, with the old table left in `path`.old.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(staged)
    fs = at(path).getFileSystem(conf)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        _renamed(fs.rename(at(path), at(old)), path)
    _renamed(fs.rename(at(staged), at(path)), staged)
    fs.delete(at(old), True)


def _renamed(done: bool, path: str) -> None:
    if not done:
        raise OSError(f"{path} could not be renamed")
