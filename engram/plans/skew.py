"""Joins whose cost does not depend on how uneven the keys are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_SHARE of the left side and more than HOT_FLOOR rows; there can be at
#: most HOT_SHARE such keys, and none where the left side has no more than HOT_FLOOR rows.
HOT_SHARE, HOT_FLOOR = 1000, 100_000


def hot_from(rows: int) -> float:
    """The number of rows above which a key is hot."""
    return max(rows / HOT_SHARE, HOT_FLOOR)


def hot_keys(counted: DataFrame, key: str, n: str, rows: int) -> DataFrame | None:
    """The hot keys of a left side with that many rows, from its keys with their counts; None if there are none."""
    if rows <= HOT_FLOOR:
        return None
    hot = counted.filter(F.col(n) > hot_from(rows)).select(key)
    return None if hot.isEmpty() else hot


def find_hot(df: DataFrame, key: str) -> DataFrame | None:
    """The hot keys of a table whose rows are cheap to count: it is read once for the number of rows, and again only if there
    are enough of them for a key to be hot."""
    return hot_keys(df.groupBy(key).agg(F.count("*").alias("n")), key, "n", df.count())


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """left join right on `key`, where right holds each key once and left may be very uneven.

    Rows of hot keys meet a broadcast of the hot keys' rows only (at most HOT_SHARE rows, see
    hot_keys); all others take the usual shuffled join. Every row of left comes out exactly once
    (how="left") or once if its key is in right (how="inner"). Null keys match nothing.
    """
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(hot.withColumn("hot", F.lit(True)))
    marked = left.join(few, key, "left")
    small = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    cold = marked.filter(F.col("hot").isNull()).drop("hot").join(right, key, how)
    return marked.filter(F.col("hot")).drop("hot").join(small, key, how).select(cold.columns).unionByName(cold)
