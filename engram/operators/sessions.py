"""Sessions of activity by pointer doubling.

Events are first folded into slots as long as the gap: within one slot all events of a key belong
together, and a session can only go on from a slot into the next one. Linking a slot to its
predecessor is therefore an equi-join on (key, slot), a key that occurs once, so a key with a third
of all events is spread over the whole cluster and never sorted in one task. The pointers are then
doubled by self-joins until every slot points at the first slot of its session: about log2 of the
longest session's slots rounds.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch

GAP_US = 30 * 60 * 1_000_000


def once_per_id(events: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row per id, the first by `order` (ties by the other columns); rows without an id all stay.

    The minimum is combined before the shuffle, so an id repeated any number of times is no hot key. Map columns
    are compared as their entries.
    """
    names = [*order, *(c for c in events.columns if c not in order and c != id_col)]
    maps = {f.name for f in events.schema.fields if f.dataType.typeName() == "map"}
    flat = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in names]
    back = [F.map_from_entries(F.col(f"_first.{c}")).alias(c) if c in maps else F.col(f"_first.{c}").alias(c) for c in names]
    kept = events.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*flat)).alias("_first"))
    return kept.select(id_col, *back).unionByName(events.filter(F.col(id_col).isNull()))


def _cells(events: DataFrame, key: str, us: str, gap_us: int, *more) -> DataFrame:
    """First and last time and number of the events of each slot (and of what `more` names)."""
    t = F.col(us)
    slot = F.floor((t - F.pmod(t, F.lit(gap_us))) / gap_us).cast("long")
    given = events.filter(F.col(key).isNotNull() & t.isNotNull()).select(F.col(key).alias("_key"), slot.alias("_slot"), t.alias("_us"), *more)
    return given.groupBy("_key", "_slot", *[c for c in given.columns if c not in ("_key", "_slot", "_us")]).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n"))


def link_slots(cells: DataFrame, scratch: Scratch, gap_us: int) -> DataFrame:
    """Cells (_key, _slot, _lo, _hi, _n; each key and slot once) with _root, the slot at which their session begins."""
    before = cells.select("_key", (F.col("_slot") + 1).alias("_slot"), F.col("_hi").alias("_before"))
    linked = F.coalesce(F.col("_lo") - F.col("_before") <= gap_us, F.lit(False))
    now = scratch.write(cells.join(before, ["_key", "_slot"], "left").select(*cells.columns, F.when(linked, F.col("_slot") - 1).otherwise(F.col("_slot")).alias("_root")))
    while True:
        target = now.select("_key", F.col("_slot").alias("_root"), F.col("_root").alias("_next"))
        then = scratch.write(now.join(target, ["_key", "_root"]).select("_key", "_slot", "_lo", "_hi", "_n", F.col("_next").alias("_root"), (F.col("_next") != F.col("_root")).alias("_moved")))
        scratch.drop(now)
        now = then
        if now.filter("_moved").isEmpty():
            return now.drop("_moved")


def sessions(events: DataFrame, key: str, us: str, gap_us: int = GAP_US) -> DataFrame:
    """One row per session: key, start_us, end_us, duration_us, n_events.

    A gap of exactly gap_us still belongs together. Rows with a null key or time are left out; an empty input gives no
    rows; repeated times are separate events. Other columns are not read, so their names do not matter.
    """
    scratch = Scratch(events.sparkSession)
    slots = link_slots(scratch.write(_cells(events, key, us, gap_us)), scratch, gap_us)
    out = slots.groupBy("_key", "_root").agg(F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("n_events"))
    return out.select(F.col("_key").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")


def session_kinds(events: DataFrame, key: str, us: str, kind: Column, gap_us: int = GAP_US) -> DataFrame:
    """Counts by kind of each session: key, start_us, end_us, kind, n_events. A null kind is a kind of its own.

    Rows are left out as in sessions(). The events are read once: cells by kind are folded into cells.
    """
    scratch = Scratch(events.sparkSession)
    fine = scratch.write(_cells(events, key, us, gap_us, kind.alias("kind")))
    cells = scratch.write(fine.groupBy("_key", "_slot").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("_n")))
    slots = scratch.write(link_slots(cells, scratch, gap_us))
    span = slots.groupBy("_key", "_root").agg(F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"))
    by_kind = fine.join(slots.select("_key", "_slot", "_root"), ["_key", "_slot"]).groupBy("_key", "_root", "kind").agg(F.sum("_n").alias("n_events"))
    return by_kind.join(span, ["_key", "_root"]).select(F.col("_key").alias(key), "start_us", "end_us", "kind", "n_events")
