"""Documents cut into chunks: fixed size with overlap, sentences, paragraphs, markdown sections.

Cutting a text is a small function of one text; Spark spreads the texts.
"""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LARGE = 512, 50, 1000
_BREAK = re.compile(r"[ \n.!?](?=[^ \n.!?]*$)")


def fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Chunks of `size` characters that end after the last break within their final `overlap` ones, each beginning `overlap` before the end of the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            m = _BREAK.search(text, max(at, end - overlap), end)
            end = m.end() if m else end
        out.append((at, end, "fixed"))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def _packed(spans: list[tuple[int, int]], size: int, kind: str) -> list[tuple[int, int, str]]:
    """Neighbouring spans together, as long as they are no longer than `size`."""
    out: list[tuple[int, int, str]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    return out


def _spans(text: str, border: str) -> list[tuple[int, int]]:
    ends = [m.end() for m in re.finditer(border, text)]
    edges = [0, *ends, len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()]


def sentences(text: str) -> list[tuple[int, int, str]]:
    return _packed(_spans(text, r"(?<=[.!?])\s+"), SIZE, "sentences")


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """Paragraphs together up to SIZE; one longer than LARGE is cut at its sentences."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in _packed(_spans(text, r"\n[ \t]*\n\s*"), SIZE, "paragraph"):
        if b - a > LARGE:
            out += [(a + x, a + y, kind) for x, y, _ in sentences(text[a:b])]
        else:
            out.append((a, b, kind))
    return out


def sections(text: str) -> list[tuple[int, int, str]]:
    """Markdown sections by heading, with the level in the kind; text before the first heading is level 0. Fenced code has no headings."""
    marks, fenced, at = [(0, 0)], False, 0
    for line in text.splitlines(keepends=True):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6}) \S", line)
        if m:
            marks.append((at, len(m.group(1))))
        at += len(line)
    edges = [*marks, (len(text), 0)]
    return [(a, b, f"section_{level}") for (a, level), (b, _) in zip(edges, edges[1:]) if text[a:b].strip()]


STRATEGIES: dict[str, Callable[[str], list[tuple[int, int, str]]]] = {"fixed": fixed, "sentences": sentences, "paragraphs": paragraphs, "sections": sections}


def chunk(df: DataFrame, key: str, text: str, strategy: str) -> DataFrame:
    """key, nth, start_pos, end_pos, chunk_type, content of every chunk; null, empty and blank texts have none."""
    cut = STRATEGIES[strategy]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, a, b, kind, t[a:b]) for k, t in zip(batch["key"], batch["text"]) for n, (a, b, kind) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["key", "nth", "start_pos", "end_pos", "chunk_type", "content"])

    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.trim("text") != "")
    return given.mapInPandas(run, f"key {kind}, nth int, start_pos int, end_pos int, chunk_type string, content string").withColumnRenamed("key", key)
