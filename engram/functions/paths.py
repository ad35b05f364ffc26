"""Time paths (date/time/category), kinds of records and references, read from text with Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of dates, times and time paths.
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIME = r"^\d{2}:\d{2}:\d{2}(?:\.\d{3})?$"
TIME_PATH = r"^(\d{4}-\d{2}-\d{2})/(\d{2}:\d{2}:\d{2}(?:\.\d{3})?)(?:/(.+))?$"

# Keys of a JSON object that tell its kind, the first kind that fits.
KINDS = (("conversation", ("message", "role", "conversation")), ("state", ("checkpoint", "state", "progress")), ("system", ("metric", "stats", "system")))

# Pattern, kind and confidence of references to documents.
REFERENCES = (
    (r"document\s*['\"]?([^'\"]+)['\"]?", "explicit", 0.9),
    (r"([^\s]+\.(?:pdf|doc|docx|txt|md))", "explicit", 0.95),
    (r"file\s*['\"]?([^'\"]+)['\"]?", "explicit", 0.85),
    (r"(?:previously|earlier|before)\s*(?:seen|read|checked)\s*(.+?)(?:in|from)", "implicit", 0.7),
    (r"(?:that|this|the)\s*(?:document|material|content)", "implicit", 0.6),
    (r"(?:as\s+)?mentioned\s+above", "implicit", 0.65),
    (r"(?:related|about)\s*(?:document|material)", "topic", 0.5),
)
# What a link is worth by kind, and the further parts of its strength: nearness in time, frequency, likeness.
LINK_WORTH = {"explicit": 0.9, "implicit": 0.6, "entity": 0.5}
OTHER_LINK, LINK_PARTS = 0.3, (0.7, 0.5, 0.6)


def kind_of(content: Column) -> Column:
    """conversation, state or system by the keys of a JSON object, document for anything else; null stays null."""
    keys = F.json_object_keys(content)
    out = F.lit("document")
    for kind, words in reversed(KINDS):
        out = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, words))), kind).otherwise(out)
    return F.when(content.isNotNull(), out)


def is_date(text: Column) -> Column:
    return text.rlike(DATE)


def is_time(text: Column) -> Column:
    return text.rlike(TIME)


def read_time_path(path: Column) -> Column:
    """struct of day, at_us (microseconds of the wall clock since 1970), category and has_ms; null where the path is none or
    its date or time does not exist."""
    part = lambda k: F.regexp_extract(path, TIME_PATH, k)
    clock = F.split(part(2), "[:.]")
    number = lambda k: F.get(clock, F.lit(k)).try_cast("long")
    day = part(1).try_cast("date")
    seconds = number(0) * 3600 + number(1) * 60 + number(2)
    at = F.unix_date(day).cast("long") * 86_400_000_000 + seconds * 1_000_000 + F.coalesce(number(3), F.lit(0)) * 1000
    good = path.rlike(TIME_PATH) & day.isNotNull() & (number(0) < 24) & (number(1) < 60) & (number(2) < 60)
    return F.when(good, F.struct(day.alias("day"), at.alias("at_us"), F.nullif(part(3), F.lit("")).alias("category"), (F.size(clock) == 4).alias("has_ms")))


def references(text: Column) -> Column:
    """Array of (kind, confidence, times) of the reference patterns that a text holds."""
    found = [F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.regexp_count(text, F.lit(f"(?i){pattern}")).alias("times")) for pattern, kind, sure in REFERENCES]
    return F.filter(F.array(*found), lambda r: r["times"] > 0)


def link_strength(kind: Column) -> Column:
    """Mean of the worth of a link's kind and the fixed parts."""
    worth = F.lit(OTHER_LINK)
    for name, value in LINK_WORTH.items():
        worth = F.when(kind == name, value).otherwise(worth)
    return (worth + F.lit(sum(LINK_PARTS))) / (1 + len(LINK_PARTS))

# Words in a path and the class that they give it, the first class that fits.
PATH_CLASSES = (("secret", ("secret", "credential", "auth")), ("confidential", ("private", "confidential")), ("internal", ("internal", "workspace")))
# Shapes of values that look encrypted, in base64 or hexadecimal digits.
SEALED = r"^(?:[A-Za-z0-9+/]{32,}={0,2}|[0-9a-fA-F]{32,})$"

_DASHED = r"^\d{2}-\d{2}-\d{2}(\.\d{3})?$"


def key_of(kind: Column, *parts: Column) -> Column:
    """memory:kind:part:part, in which the colons of clock times become dashes; null parts are left out."""
    safe = [F.when(p.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d{3})?$"), F.replace(p, F.lit(":"), F.lit("-"))).otherwise(p) for p in parts]
    return F.concat_ws(":", F.lit("memory"), kind, *safe)


def parts_of(key: Column) -> Column:
    """Parts of a key behind its kind, clock times with their colons again; null where the key has no part.

    A clock time whose hour is 20 looks like the beginning of a year and keeps its dashes.
    """
    parts = F.split(key, ":")
    back = lambda p: F.when(p.rlike(_DASHED) & ~F.startswith(p, F.lit("20")), F.replace(p, F.lit("-"), F.lit(":"))).otherwise(p)
    return F.when(F.size(parts) >= 3, F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), back))


def file_name(path: Column) -> Column:
    """A path as the name of a file: no steps upwards, no slashes, 255 characters at most."""
    return F.substring(F.regexp_replace(F.replace(path, F.lit(".."), F.lit("")), r"[/\\]", "_"), 1, 255)


def path_class(path: Column) -> Column:
    """secret, confidential, internal or public, by words in a path."""
    low, out = F.lower(path), F.lit("public")
    for name, words in reversed(PATH_CLASSES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return F.when(path.isNotNull(), out)


def looks_sealed(value: Column) -> Column:
    """Whether a value looks encrypted; null stays null."""
    return value.rlike(SEALED)
