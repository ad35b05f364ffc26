"""Scores of importance, time and relevance, as Column functions; the clock is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, steps and thresholds.
IMPORTANCE_WEIGHTS = (0.25, 0.20, 0.30, 0.15, 0.10)
TIERS = (("hot", 0.7, 365), ("warm", 0.4, 90), ("cold", 0.2, 30), ("archive", 0.0, 7))
RERANK_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
BOOSTS = ((3_600, 0.3), (86_400, 0.2), (604_800, 0.1))
RANKS = (("critical", 5), ("high", 4), ("medium", 3), ("low", 2), ("trivial", 1))
NEARNESS = ((60, 1.0), (300, 0.9), (3_600, 0.7), (86_400, 0.5), (604_800, 0.3), (2_592_000, 0.1))


def steps(value: Column, table: tuple, other: float) -> Column:
    """The result of the first limit that is not below the value."""
    out = F.lit(other)
    for limit, result in reversed(table):
        out = F.when(value <= limit, result).otherwise(out)
    return out


def temporal_boost(age_s: Column) -> Column:
    return steps(age_s, BOOSTS, 0.0)


def nearness(delta_s: Column) -> Column:
    return steps(F.abs(delta_s), NEARNESS, 0.0)


def access_frequency(n: Column) -> Column:
    """Grows with the logarithm of the number of accesses, at most 1; null counts as none."""
    return F.least(F.lit(1.0), F.log10(F.coalesce(n, F.lit(0)) + F.lit(1)) * 0.5)


def recency(age_s: Column) -> Column:
    """Falls by e in ten whole days; no access gives 0."""
    return F.coalesce(F.exp(-F.floor(age_s / 86_400) / 10.0), F.lit(0.0))


def weighted(parts: list[Column], weights: tuple[float, ...]) -> Column:
    """Mean of the parts that are not null, by weight."""
    over = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    under = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    return over / F.nullif(under, F.lit(0.0))


def tier(score: Column) -> Column:
    out = F.lit(TIERS[-1][0])
    for name, least, _ in reversed(TIERS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def ttl_days(score: Column, access: Column, references: Column, rating: Column) -> Column:
    """Days to live: the tier's, longer for what is used, cited or rated well, at most five years."""
    base = F.lit(TIERS[-1][2])
    for _, least, days in reversed(TIERS[:-1]):
        base = F.when(score >= least, days).otherwise(base)
    times = F.when(access > 0.5, 1.5).otherwise(1.0) * F.when(references > 0.3, 1.3).otherwise(1.0) * F.when(rating > 0.7, 2.0).otherwise(1.0)
    return F.least(F.floor(base * F.least(F.greatest(times, F.lit(0.5)), F.lit(5.0))), F.lit(1825)).cast("int")


def importance_rank(name: Column) -> Column:
    out = F.lit(3)
    for word, rank in RANKS:
        out = F.when(F.lower(name) == word, rank).otherwise(out)
    return out


def content_quality(fields, text: Column, has_tags: Column, has_source: Column) -> Column:
    """0.4 of the share of fields that are filled, 0.3 for a good length (half of that for a fair one), 0.15 each for tags and a
    source; 1 at most. Null and empty count as not filled, a null text as empty."""
    filled = sum((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int") for f in fields)
    size = F.length(F.coalesce(text, F.lit("")))
    fair = F.when(size.between(50, 5000), 0.3).when(size.between(10, 10_000), 0.15).otherwise(0.0)
    extra = F.when(has_tags, 0.15).otherwise(0.0) + F.when(has_source, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), filled / F.lit(float(len(fields))) * 0.4 + fair + extra)
