"""Words, phrases and patterns in text, as Column functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# Words that carry no content when texts are compared.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "under",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
)
# Stop words of topics.
TOPIC_STOP_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def content_words(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(F.array_distinct(words(text)), F.array(*map(F.lit, STOP_WORDS)))


def _equal(word: str):
    return lambda t: t == F.lit(word)


def _near(word: str, distance: int):
    return lambda t: F.levenshtein(t, F.lit(word)) <= distance


def keyword_score(text: Column, query: str) -> Column:
    """Share of the text's words that are query words (each as often as the query has it), half as much again if the
    whole query occurs in the text, at most 1; null where the text has no words."""
    terms = query.lower().split()
    every = words(text)
    hits = sum((F.size(F.filter(every, _equal(w))) for w in terms), F.lit(0))
    share = hits / F.nullif(F.size(every), F.lit(0)) * F.when(F.contains(F.lower(text), F.lit(query.lower())), 1.5).otherwise(1.0)
    return F.when(F.size(every) > 0, F.least(F.lit(1.0), share))


def has_all_words(text: Column, query: str) -> Column:
    """Every query word occurs somewhere in the text, inside other words too."""
    low = F.lower(text)
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.contains(low, F.lit(w))
    return out


def fuzzy_words(text: Column, query: str, most: int = 5, distance: int = 1) -> Column:
    """Each of the first words of the query is within an edit distance of some word of the text."""
    out = F.lit(True)
    for w in query.lower().split()[:most]:
        out = out & F.exists(words(text), _near(w, distance))
    return out


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
