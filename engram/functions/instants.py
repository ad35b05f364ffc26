"""One UTC instant from timestamps in mixed notations, precisions and zones.

A cascade of anchored patterns rewrites each text to a few fields; the fields are then checked
strictly and turned to microseconds. All of it is built-in Column expressions.

Policy: a zone, offset or abbreviation in the text wins over the source's zone. A wall clock that
occurs twice or not at all in its zone (a change of summer time) gives null, as does any text that
is no valid time or needs a zone it has not.
"""

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as written in the texts.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
}
# Zone abbreviations with one meaning, in minutes east of UTC.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "kst": 540, "jst": 540, "cet": 60, "cest": 120, "edt": -240, "est": -300, "aest": 600, "aedt": 660, "cdt": -300, "mdt": -360, "mst": -420, "pdt": -420, "pst": -480, "eet": 120, "eest": 180, "wet": 0, "west": 60}
#: Zone ids that a text may name.
ZONES = sorted(z for z in zoneinfo.available_timezones() if "/" in z)
# Weekdays, Monday first.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_ZONE = r"\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?(?:\[([A-Za-z0-9_/+-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: Anchored patterns and the fields they give: y|m|d|h|min|s|fraction|am or pm|zone|weekday|bracketed zone. D marks all-numeric dates
#: in the order of the source.
PATTERNS = (
    (r"^(\d{4})-(\d{2})-(\d{2})[Tt /]" + _TIME + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8||$9"),
    (r"^(\d{4})-(\d{2})-(\d{2})/(\d{2})-(\d{2})-(\d{2})$", "$1|$2|$3|$4|$5|$6|||||"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8||$9"),
    (r"^((?:19|20|21)\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||||"),
    (r"^(?:([A-Za-z]{3}), )?(\d{1,2}) ([A-Za-z]{3,9}) (\d{4}) " + _TIME + _ZONE + "$", "$4|$3|$2|$5|$6|$7|$8||$9|$1|$10"),
    (r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4}) " + _TIME + r"(?: ([AaPp])[Mm])?" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||$10"),
    (r"^(\d{1,2})\. ([A-Za-zäÄ]{3,9}) (\d{4}), (\d{1,2}):(\d{2})(?::(\d{2}))? Uhr$", "$3|$2|$1|$4|$5|$6|||||"),
    (r"^(\d{4})년 (\d{1,2})월 (\d{1,2})일 (오전|오후) (\d{1,2})시 (\d{1,2})분(?: (\d{1,2})초)?$", "$1|$2|$3|$5|$6|$7||$4|||"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2}) " + _TIME + r"(?: ([AaPp])[Mm])?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9||$10"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) " + _TIME + r"(?: ([AaPp])[Mm])?" + _ZONE + "$", "D$3|$1|$2|$4|$5|$6|$7|$8|$9||$10"),
)
#: Bare counts since 1970 and their unit, by digits.
COUNTS = ((r"^\d{9,10}(?:\.\d+)?$", "s"), (r"^\d{12,13}$", "ms"), (r"^\d{15,16}$", "us"), (r"^\d{18,19}$", "ns"))


def _lookup(words: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), F.coalesce(key, F.lit("")))


def count_micros(text: Column) -> Column:
    """Microseconds of a bare count of seconds, milli-, micro- or nanoseconds since 1970, finer digits cut off."""
    part = F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise("")
    worth = {
        "s": F.concat(F.substring_index(text, ".", 1), F.rpad(F.substring(part, 1, 6), 6, "0")),
        "ms": F.concat(text, F.lit("000")),
        "us": text,
        "ns": F.regexp_replace(text, r"\d{3}$", ""),
    }
    out = F.lit(None).cast("string")
    for pattern, unit in COUNTS:
        out = F.when(text.rlike(pattern), worth[unit]).otherwise(out)
    return out.try_cast("long")


def _shift(us: Column, zone: Column) -> Column:
    """Wall clock, in microseconds, of an instant in a zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def wall_to_utc(df: DataFrame, local: str, zone: str, out: str) -> DataFrame:
    """Add the one instant at which the zone's wall clock shows `local`; null if there are two or none.

    The offsets a day before and a day after give both candidates, whatever the size of the change.
    """
    at, place, day = F.col(local), F.col(zone), 86_400_000_000
    df = df.withColumns({"_first": 2 * at - day - _shift(at - day, place), "_second": 2 * at + day - _shift(at + day, place)})
    df = df.withColumns({"_ok1": _shift(F.col("_first"), place) == at, "_ok2": _shift(F.col("_second"), place) == at})
    one = F.when(F.col("_first") == F.col("_second"), F.when(F.col("_ok1"), F.col("_first"))).when(F.col("_ok1") & F.col("_ok2"), F.lit(None)).when(F.col("_ok1"), F.col("_first")).when(F.col("_ok2"), F.col("_second"))
    return df.withColumn(out, one).drop("_first", "_second", "_ok1", "_ok2")


def add_utc_micros(df: DataFrame, text: str, zone: str, order: str, out: str = "utc_us") -> DataFrame:
    """Add microseconds since 1970-01-01 UTC of a text, or null where it fixes no single instant.

    zone: column with the zone id of the text's source, or null; order: column with YMD, DMY or MDY,
    how the source writes all-numeric dates. Null and empty texts give null; blanks around a
    text do not count. Every row comes out once, with all its columns, whatever their names; one named `out` is
    replaced. The steps are separate projections, so that each field is computed once: filter on the result behind
    an aggregation or a written table, as a filter right behind it would be pushed down with a copy of every step.
    """
    kept = [c for c in df.columns if c != out]
    t = F.trim(F.col(text))
    df = df.select(F.struct(*kept).alias("_row"), t.alias("_t"), F.col(zone).alias("_zone"), F.col(order).alias("_order"))
    fields = F.lit(None).cast("string")
    for pattern, names in reversed(PATTERNS):
        fields = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, names)).otherwise(fields)
    df = df.withColumn("_part", F.split(fields, r"\|", 11))
    part = [F.col("_part")[k] for k in range(11)]
    number = lambda c: c.try_cast("int")
    dated, dmy = F.startswith(part[0], F.lit("D")), F.col("_order")
    df = df.withColumns({
        "_y": number(F.regexp_replace(part[0], "D", "")),
        "_m": F.when(~dated, F.coalesce(number(part[1]), _lookup(MONTHS, F.lower(part[1])))).when(dmy == "DMY", number(part[2])).when(dmy == "MDY", number(part[1])),
        "_d": F.when(~dated, number(part[2])).when(dmy == "DMY", number(part[1])).when(dmy == "MDY", number(part[2])),
        "_h": F.when(part[7] == "", number(part[3])).when(number(part[3]).between(1, 12), number(part[3]) % 12 + F.when(F.lower(part[7]).isin("p", "오후"), 12).otherwise(0)),
        "_min": number(part[4]),
        "_s": F.when(part[5] == "", 0).otherwise(number(part[5])),
        "_fine": F.rpad(F.substring(part[6], 1, 6), 6, "0").try_cast("long"),
        "_weekday": F.lower(part[9]),
        "_mark": F.when(part[8] == "", part[10]).otherwise(part[8]),
    }).drop("_part")
    sane = F.expr("_y BETWEEN 1 AND 9999 AND _m BETWEEN 1 AND 12 AND _h BETWEEN 0 AND 23 AND _min BETWEEN 0 AND 59 AND _s BETWEEN 0 AND 59")
    df = df.withColumn("_month", F.when(sane, F.make_date("_y", "_m", F.lit(1))))
    df = df.withColumn("_date", F.when(F.col("_d").between(1, F.dayofmonth(F.last_day("_month"))), F.date_add("_month", F.col("_d") - 1)))
    right_day = (F.col("_weekday") == "") | (F.col("_weekday") == F.try_element_at(F.array(*map(F.lit, DAYS)), F.weekday("_date") + 1))
    offset = r"^([+-])(\d{2}):?(\d{2})?$"
    df = df.withColumns({
        "_local": F.when(right_day, F.unix_date("_date").cast("long") * 86_400_000_000 + (F.col("_h") * 3600 + F.col("_min") * 60 + F.col("_s")).cast("long") * 1_000_000 + F.col("_fine")),
        "_oh": number(F.regexp_extract("_mark", offset, 2)),
        "_om": F.coalesce(number(F.regexp_extract("_mark", offset, 3)), F.lit(0)),
        "_place": F.when(F.col("_mark") == "", F.col("_zone")).when(F.col("_mark").isin(*ZONES), F.col("_mark")),
    })
    by_offset = F.when(F.expr("_oh BETWEEN 0 AND 18 AND _om BETWEEN 0 AND 59"), (F.col("_oh") * 60 + F.col("_om")) * F.when(F.startswith("_mark", F.lit("-")), -1).otherwise(1))
    df = df.withColumn("_east", F.coalesce(by_offset, _lookup(ABBREVIATIONS, F.lower("_mark"))))
    df = wall_to_utc(df, "_local", "_place", "_wall")
    instant = F.coalesce(count_micros(F.col("_t")), F.when(F.col("_east").isNotNull(), F.col("_local") - F.col("_east").cast("long") * 60_000_000).otherwise(F.col("_wall")))
    return df.select("_row.*", instant.alias(out))
