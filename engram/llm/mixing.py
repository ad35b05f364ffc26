"""Mixtures of sources at target shares of their size, by Pareto order sampling.

Each record is expected `copies` times: its source's rate (for very long records less, if that is asked
for), and never more than the source allows. The whole part of that is certain; what is left over is
the probability of one copy more. Those copies go to the records with the lowest random odds divided by
inclusion odds, taken until the source's size is reached: a sample of fixed size with unequal
probabilities, which a hash of the key makes repeatable.

A source is never ranked in one task: a histogram of the ranking values gives the slice in which a
source's line falls, and only that slice, one of SLICES, is ranked row by row. Sizes, rates, histograms
and lines of the sources are tables; two sums over all sources are all that the driver sees, so any
number of sources will do.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch
from engram.plans.skew import HOT_FLOOR, hot_keys, join_unique

SEED, SLICES, HALVES = 29, 4096, 12


def rate(classes: list[tuple[float, int]], most: int, size: float) -> float:
    """The source's rate c with sum(min(most, c * weight) * tokens) = size, over (weight, tokens)."""
    classes = sorted((c for c in classes if c[1] > 0), reverse=True)
    full, rest = 0.0, sum(w * t for w, t in classes)
    for w, t in classes:
        c = (size - full) / rest if rest > 0 else 0.0
        if c * w <= most:
            return max(0.0, c)
        full, rest = full + most * t, rest - w * t
    return most / min((w for w, _ in classes), default=1.0)


def planned(sizes: DataFrame, aims: DataFrame, total: float | None, scratch: Scratch) -> DataFrame:
    """source, rate, most, wanted of each source that has both a target and records.

    sizes: source, halves, n (tokens; at most HALVES + 1 rows a source). Targets count among the sources that have
    records. Without a total, the mixture is as large as the targets allow. Where a given total asks more of a source than
    all its copies, it gives all of them and the others keep their sizes.
    """
    have = sizes.groupBy("source").agg(F.sum("n").alias("have"), F.collect_list(F.struct("halves", "n")).alias("classes"))
    both = scratch.write(have.join(aims, "source").withColumn("limit", (F.col("most") * F.col("have")).cast("double")))
    all_ = both.agg(F.sum("share").alias("whole"), F.min(F.col("limit") / F.col("share")).alias("least")).first()
    whole, least = (all_["whole"] or 1.0), (all_["least"] or 0.0)
    sized = both.withColumn("wanted", F.least(F.lit(float(least * whole if total is None else total)) * F.col("share") / F.lit(float(whole)), "limit"))

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = [rate([(2.0 ** -x["halves"], x["n"]) for x in classes], most, wanted) for classes, most, wanted in zip(batch["classes"], batch["most"], batch["wanted"])]
            yield pd.DataFrame({"source": batch["source"], "rate": c, "most": batch["most"], "wanted": batch["wanted"]})

    kind = both.schema["source"].dataType.simpleString()
    return scratch.write(sized.select("source", "classes", "most", "wanted").mapInPandas(rates, f"source {kind}, rate double, most int, wanted double"))


def _line(slices: DataFrame, room: DataFrame) -> DataFrame:
    """source, cut, left: the slice behind `after` in which the room is filled, and the room that the slices before leave it."""
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    summed = slices.join(room, "source").filter("slice > after").select("source", "slice", "n", "room", upto.alias("upto"))
    return summed.filter("upto > room AND upto - n <= room").select("source", F.col("slice").alias("cut"), (F.col("room") - F.col("upto") + F.col("n")).alias("left"))


def _on_line(rows: DataFrame) -> DataFrame:
    """The rows of slices with a line, with `taken`: a record that crosses the line is taken if most of it lies before the line."""
    reached = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reached", reached).withColumn("taken", F.col("reached") - F.col("tokens") / 2 <= F.col("left"))


def mixture(records: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total: float | None = None, halve_above: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, tokens, copies) and a report of shares. Both are computed when this is called.

    records hold a size in `tokens` per key; records of null or unknown sources, without a size or of size
    zero take no part. targets: source, target_share, max_repeats; rows with a null or non-positive share
    are left out, repeated ones count once, a null or smaller max_repeats is 1. Records repeated under one
    key take part as often as they come. Ties of the ranking value go by key.
    halve_above: if given, records longer than so many times their source's mean are expected half as often, those of
    twice that length a quarter as often and so on; by default length makes no difference.
    report: source, target_share, records, available, wanted, used, reached_share; a target without
    records is reported with zeros.
    """
    scratch = Scratch(records.sparkSession)
    kept = targets.filter("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share)").groupBy("source")
    aims = kept.agg(F.max("target_share").alias("share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).cast("int").alias("most"))
    rows = records.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).filter("source IS NOT NULL AND tokens > 0")
    rows, seen = scratch.counted(rows.join(aims.select("source"), "source", "left_semi"))
    per_source = scratch.write(rows.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available")))
    hot = hot_keys(per_source, "source", "records", seen["n"]) if seen["n"] > HOT_FLOOR else None
    if halve_above is None:
        classed = rows.withColumn("halves", F.lit(0))
    else:
        mean = per_source.select("source", (F.col("available") / F.col("records")).alias("mean"))
        halves = F.least(F.lit(HALVES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("tokens") / (F.lit(float(halve_above)) * F.col("mean"))))).cast("int"))
        classed = join_unique(rows, mean, "source", hot, "inner").withColumn("halves", halves).drop("mean")
    plan = planned(classed.groupBy("source", "halves").agg(F.sum("tokens").alias("n")), aims, total, scratch)
    expected = F.least(F.col("most").cast("double"), F.col("rate") * F.pow(F.lit(2.0), -F.col("halves")))
    base = join_unique(classed, plan, "source", hot, "inner").withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int"))
    u = (F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 50)).cast("double") + 0.5) / float(1 << 50)
    base = base.withColumn("p", F.least(F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)), F.lit(1 - 1e-9))).withColumn("u", u)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    order = F.when(F.col("p") > 1e-9, odds / (1 + odds))
    ranked = scratch.write(base.withColumn("order", order).withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(F.col("order") * SLICES)).cast("int")).select("key", "source", "tokens", "whole", "order", "slice"))
    scratch.drop(rows)
    # by source: the slice in which the wanted size is reached; what a long record there leaves open is filled from later ones
    slices = scratch.write(ranked.groupBy("source", "slice").agg(F.sum(F.col("whole") * F.col("tokens")).alias("certain"), F.sum("tokens").alias("n")))
    certain = slices.groupBy("source").agg(F.sum("certain").alias("certain"))
    room = plan.join(certain, "source").select("source", (F.col("wanted") - F.col("certain")).alias("room"), F.lit(-1).alias("after"))
    first = scratch.write(_line(slices, room).select("source", F.col("cut").alias("cut1"), F.col("left").alias("left1")))
    chosen = _on_line(join_unique(ranked, first, "source", hot, "inner").filter("slice = cut1").withColumn("left", F.col("left1"))).filter("taken")
    spent = first.join(chosen.groupBy("source").agg(F.sum("tokens").alias("spent")), "source", "left")
    room = spent.select("source", (F.col("left1") - F.coalesce("spent", F.lit(0))).alias("room"), F.col("cut1").alias("after"))
    second = _line(slices, room).select("source", F.col("cut").alias("cut2"), F.col("left").alias("left2"))
    lines = scratch.write(first.join(second, "source", "left"))
    placed = join_unique(ranked, lines, "source", hot)
    at_line = F.coalesce((F.col("slice") == F.col("cut1")) | (F.col("slice") == F.col("cut2")), F.lit(False))
    # without a line all of a source's rest is taken, without a second one nothing behind the first
    within = F.col("cut1").isNull() | (F.col("slice") < F.col("cut1")) | ((F.col("slice") > F.col("cut1")) & (F.col("slice") < F.col("cut2")))
    plain = placed.filter(~at_line).withColumn("copies", F.col("whole") + F.when(F.col("slice").isNotNull() & within, 1).otherwise(0))
    ranked_ones = _on_line(placed.filter(at_line).withColumn("left", F.when(F.col("slice") == F.col("cut1"), F.col("left1")).otherwise(F.col("left2"))))
    ranked_ones = ranked_ones.withColumn("copies", F.col("whole") + F.col("taken").cast("int"))
    names = ["key", "source", "tokens", "copies"]
    mixed = scratch.write(plain.select(names).unionByName(ranked_ones.select(names)).filter("copies > 0"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all"))
    report = aims.join(per_source, "source", "left").join(plan.select("source", "wanted"), "source", "left").join(used, "source", "left").crossJoin(F.broadcast(whole))
    report = report.select("source", F.col("share").alias("target_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "available")), F.coalesce("wanted", F.lit(0.0)).alias("wanted"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("used", "most_copies")), F.coalesce(F.col("used") / F.col("all"), F.lit(0.0)).alias("reached_share"))
    return mixed.select(F.col("key").alias(key), "source", "tokens", "copies"), report
