"""Searches: by words, phrase, time, key pattern and vector."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import glob_regex, has_all_words, keyword_score

#: Queries and rows that are compared at once; distances closer than SLACK are compared again, row by row.
QUERY_BLOCK, ROW_BLOCK, SLACK = 512, 8192, 1e-9


def keyword(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows with all words of the query, with their score."""
    return df.filter(has_all_words(F.col(text), query)).withColumn("score", keyword_score(F.col(text), query))


def between(df: DataFrame, at: str, since: str, until: str) -> DataFrame:
    """Rows from the first day's start to the last day's end; both days count whole."""
    t = F.col(at).cast("timestamp_ntz")
    return df.filter((t >= F.lit(since).cast("timestamp_ntz")) & (t < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz")))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def by_pattern(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose key matches a glob."""
    return df.filter(F.col(key).rlike(glob_regex(pattern)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where their lengths differ or one has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norms > 0), dot(x, y) / norms).otherwise(0.0)


def _packed(df: DataFrame, key: str, vector: str, rows: int, name: str) -> DataFrame:
    """Blocks of at most so many rows with vectors of one length; a null vector, or one with a null in it, has length 0."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["vector"].map(lambda v: 0 if v is None else len(v))):
                for at in range(0, len(part), rows):
                    block = part.iloc[at : at + rows]
                    raw = np.stack(block["vector"].to_list()).astype(np.float64).tobytes() if size else b""
                    yield pd.DataFrame({f"{name}_ids": [block["id"].to_list()], f"{name}_size": [size], f"{name}_raw": [raw]})

    whole = F.col(vector).cast("array<double>")
    given = df.select(F.col(key).alias("id"), F.when(~F.exists(whole, lambda x: x.isNull()), whole).alias("vector"))
    return given.mapInPandas(pack, f"{name}_ids array<{given.schema['id'].dataType.simpleString()}>, {name}_size int, {name}_raw binary")


def _best(wanted: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each wanted vector its k nearest rows and their distances; ties by rank. Near misses of the matrix product are compared exactly."""
    if wanted.shape[1] != rows.shape[1] or not rows.shape[1]:
        first = np.argsort(rank)[:k]
        yield from ((i, first, np.ones(len(first))) for i in range(len(wanted)))
        return
    with np.errstate(all="ignore"):
        long, far = np.sqrt((wanted * wanted).sum(1)), np.sqrt((rows * rows).sum(1))
        norms = long[:, None] * far[None, :]
        distance = 1 - np.where(norms == 0, 0.0, wanted @ rows.T / norms)
        limit = np.partition(distance, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1] + SLACK
        for i, most in enumerate(limit):
            at = np.arange(len(rows)) if np.isnan(most) else np.flatnonzero(distance[i] <= most)
            exact = 1 - np.where(norms[i, at] == 0, 0.0, (rows[at] * wanted[i]).sum(1) / norms[i, at])
            order = np.lexsort((rank[at], exact))[:k]
            yield i, at[order], exact[order]


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to each query vector (queries: unique `query`, `wanted`): query, key, distance; ties by key.

    Blocks of queries meet blocks of rows, and only the k best of a block go on. Vectors of another length, without length
    or with nulls have distance 1.
    """
    left = _packed(queries.repartition("query"), "query", "wanted", QUERY_BLOCK, "q")
    pairs = left.crossJoin(_packed(df, key, vector, ROW_BLOCK, "r"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples(index=False):
                wanted = np.frombuffer(one.q_raw, np.float64).reshape(len(one.q_ids), one.q_size)
                rows = np.frombuffer(one.r_raw, np.float64).reshape(len(one.r_ids), one.r_size)
                rank = np.empty(len(rows), np.int64)
                rank[sorted(range(len(rows)), key=one.r_ids.__getitem__)] = np.arange(len(rows))
                found = [(one.q_ids[i], one.r_ids[j], d) for i, at, far in _best(wanted, rows, rank, k) for j, d in zip(at, far, strict=True)]
                yield pd.DataFrame(found, columns=["query", "key", "distance"])

    kinds = [frame.schema[name].dataType.simpleString() for frame, name in ((queries, "query"), (df, key))]
    scored = pairs.mapInPandas(score, f"query {kinds[0]}, key {kinds[1]}, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("query", F.col("key").alias(key), "distance")


def near_duplicates(df: DataFrame, key: str, vector: str, queries: DataFrame, least: float = 0.95, k: int = 5) -> DataFrame:
    """For each query vector (see nearest; `query` is the key of its own row) at most k other rows of a cosine of `least` or
    more: query, key, similarity; ties by key."""
    near = nearest(df, key, vector, queries, k + 1).filter((F.col(key) != F.col("query")) & (F.col("distance") <= 1 - least))
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("query", key, (1 - F.col("distance")).alias("similarity"))


def neighbours_in_time(df: DataFrame, key: str, us: str, within_us: int, parts: int = 60) -> DataFrame:
    """For each row the one before it in time, if it is within that long: key, before, proximity (1 - gap / within).

    Time is cut into slots, `parts` of them as long as within_us. Rows are ordered within their slot only; the last row of each
    slot is lent to the `parts` slots behind it, for their first rows. A bulk load meets in one task only as far as its times
    lie in one slot: more parts make slots shorter. Rows without a time are left out.
    """
    fine = -(-within_us // parts)
    slot = F.floor((F.col(us) - F.pmod(F.col(us), F.lit(fine))) / fine)
    given = df.filter(F.col(us).isNotNull()).select(F.col(key).alias("key"), F.col(us).alias("us"), slot.alias("slot"))
    last = given.groupBy("slot").agg(F.max(F.struct("us", "key")).alias("last"))
    behind = last.select("slot", "last", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("k"))
    lent = behind.groupBy((F.col("slot") + F.col("k")).alias("slot")).agg(F.max("last").alias("lent"))
    w = Window.partitionBy("slot").orderBy("us", "key")
    inner = given.withColumn("inner", F.lag(F.struct("us", "key")).over(w))
    before = inner.join(lent, "slot", "left").select("key", "us", F.coalesce("inner", "lent").alias("before"))
    gap = F.col("us") - F.col("before.us")
    return before.filter(gap <= within_us).select(F.col("key").alias(key), F.col("before.key").alias("before"), (1 - gap / within_us).alias("proximity"))
