"""Personal data in free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

Every character of every text is read. A text is cut into overlapping windows; the LSTM scores the
tags of each character of a window, and of two windows that overlap each gives the scores of its half
of the overlap, so that all characters are scored with what stands on both sides of them. The best
tags are then decided globally over the whole text, however long: characters that must be outside in
any best path (see Tagger.sure) divide a text into stretches that can be decided apart without a
change of the result, and all stretches of many texts are decided together.

Spark hands batches of whole texts to the workers; rows are independent and nothing is shuffled but
the mentions found. The weights were trained by pii_training.py and lie beside this file.
"""

import functools
import io
import pkgutil
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; 1 + 2k begins kind k and 2 + 2k goes on with it.
N_TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 256, 64
#: Windows scored together; steps whose states are held at a time; characters whose scores are in memory at a time.
BATCH, STEPS, HELD = 128, 16, 1_000_000
#: Score of what a tag sequence must not do.
NEVER = -1e4


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point of the basic plane: digits share one, Hangul and rarer characters share buckets."""
    table = np.zeros(65536, np.int16)
    table[:128] = np.arange(128)
    table[48:58] = 48
    for cp in range(128, 0x2000):
        ch = chr(cp)
        table[cp] = 128 if ch.isupper() else 129 if ch.islower() else 130 + cp % 6
    table[0x2000:] = 140 + np.arange(0x2000, 65536) % 12
    table[0xAC00:0xD7A4] = 156 + np.arange(0xAC00, 0xD7A4) % 61
    table[0xFF20] = 64
    table[0x2018:0x201A] = 39
    return table


N_CLASSES = 220


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return classes()[np.minimum(points, 65535)]


def windows(length: int) -> list[tuple[int, int]]:
    """Windows of equal size that cover a text of that length; neighbours share OVERLAP characters or more."""
    if length <= WINDOW:
        return [(0, length)] if length else []
    n = -(-(length - OVERLAP) // (WINDOW - OVERLAP))
    size = -(-(length + (n - 1) * OVERLAP) // n)
    return [(a, a + size) for a in (k * (length - size) // (n - 1) for k in range(n))]


def owned(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The part of the text that each window decides: up to the middle of what it shares with its neighbours."""
    edges = [0, *((b + c) // 2 for (_, b), (c, _) in zip(cuts, cuts[1:])), cuts[-1][1]] if cuts else []
    return list(zip(edges, edges[1:]))


class Tagger:
    """wx: direction, class, 4H; wh: direction, H, 4H; out: 2H, tags; bias, start: tags; trans: tags, tags.

    Gates (in, keep, out) are clip(x / 4 + 1/2, 0, 1), the squashing is x / (1 + |x|): cheap in numpy, and what the
    weights were trained with.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = w = {k: np.array(v, np.float32) for k, v in weights.items()}
        size = self.size = w["wh"].shape[1]
        wx, wh = w["wx"].reshape(2, -1, 4, size).copy(), w["wh"].reshape(2, size, 4, size).copy()
        # x / 4 + 1/2 of the gates is computed at once
        wx[:, :, :3] = wx[:, :, :3] / 4 + 0.5
        wh[:, :, :3] /= 4
        # before a shorter window begins, backwards, all gates are shut and the state stays zero
        shut = np.zeros((1, 4, size), np.float32)
        shut[:, :3] = -1e4
        self.wx = np.ascontiguousarray(np.concatenate([wx.reshape(-1, 4, size), shut]).transpose(1, 0, 2))
        self.wh = np.ascontiguousarray(wh.transpose(2, 0, 1, 3))
        # only a mention's own characters may go on with it
        for k in range(len(KINDS)):
            others = [a for a in range(N_TAGS) if a not in (1 + 2 * k, 2 + 2 * k)]
            w["trans"][others, 2 + 2 * k] = w["start"][2 + 2 * k] = NEVER
        t, start, kinds = w["trans"], w["start"], range(len(KINDS))
        #: The most that a row of mentions without a gap wins by transitions over the outside: when it begins with a kind, when
        #: it ends, and for each further character.
        self.begin = np.array([max(t[0, 1 + 2 * k] - t[0, 0], start[1 + 2 * k] - start[0]) for k in kinds], np.float32)
        self.end = max(0.0, float((t[1:, 0] - t[0, 0]).max()))
        self.step = float(t[1:, 1:].max() - t[0, 0])

    @classmethod
    @functools.cache
    def load(cls) -> "Tagger":
        with np.load(io.BytesIO(pkgutil.get_data(__package__, "pii_weights.npz"))) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def scores(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Scores of the tags at each character of each window: longest, windows, tags."""
        n, size, longest = len(seqs), self.size, max(map(len, seqs))
        back = self.wx.shape[1] // 2
        x = np.full((longest, 2, n), 2 * back, np.int64)
        for row, s in enumerate(seqs):
            x[: len(s), 0, row] = s
            x[longest - len(s) :, 1, row] = s[::-1] + back
        x = x.reshape(longest, 2 * n)
        out = self.w["out"].reshape(2, size, N_TAGS)
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        states = np.empty((STEPS, 2, n, size), np.float32)
        both = np.empty((2, longest, n, N_TAGS), np.float32)
        z, seen = np.empty((4, 2, n, size), np.float32), np.empty((4, 2 * n, size), np.float32)
        flat, gates, (into, keep, give, new) = z.reshape(4, 2 * n, size), z[:3], z
        takes = [w.take for w in self.wx]
        u, d = np.empty_like(h), np.empty_like(h)
        for t in range(longest):
            np.matmul(h, self.wh, out=z)
            for take, to in zip(takes, seen):
                take(x[t], 0, to, "clip")
            flat += seen
            np.clip(gates, 0, 1, out=gates)
            np.abs(new, out=d)
            d += 1
            np.divide(new, d, out=u)
            u *= into
            c *= keep
            c += u
            np.abs(c, out=d)
            d += 1
            np.divide(c, d, out=d)
            at = t % STEPS
            h = np.multiply(give, d, out=states[at])
            if at == STEPS - 1 or t == longest - 1:
                for way in (0, 1):
                    both[way, t - at : t + 1] = (states[: at + 1, way].reshape(-1, size) @ out[way]).reshape(at + 1, n, N_TAGS)
        e = both[0]
        e += both[1, ::-1]
        e += self.w["bias"]
        return e

    def sure(self, e: np.ndarray) -> np.ndarray:
        """Characters that no best path tags: every row of mentions over them would lose more by its scores than its transitions
        can win."""
        e = np.ascontiguousarray(e.T)
        total = np.cumsum((e[1:].max(0) - e[0]).astype(np.float64) + self.step)
        begun = (e[1::2] + self.begin[:, None]).max(0) - e[0]
        # the best row that has begun and goes on to here, and what it can win behind this character
        till = total + np.maximum.accumulate(begun - total)
        behind = np.maximum.accumulate(total[::-1])[::-1] - total
        return till + behind + self.end < -1e-3

    def decide(self, scores: np.ndarray, stretches: np.ndarray) -> dict[int, np.ndarray]:
        """Best tags of the stretches that have any, by number.

        stretches: from, to, whether it begins its text, whether it ends it; other neighbours are outside.
        """
        out: dict[int, np.ndarray] = {}
        sizes = stretches[:, 1] - stretches[:, 0]
        order = np.argsort(sizes, kind="stable")
        trans, start = self.w["trans"], self.w["start"]
        back = np.ascontiguousarray(trans.T)
        for at in range(0, len(order), 4 * BATCH):
            part = order[at : at + 4 * BATCH]
            lengths = sizes[part]
            longest = int(lengths[-1])
            steps = np.arange(longest)[:, None]
            e = np.ascontiguousarray(scores[stretches[part, 0] + np.minimum(steps, lengths - 1)].transpose(0, 2, 1))
            best = np.empty_like(e)
            best[0] = np.where(stretches[part, 2], start[:, None], trans[0][:, None]) + e[0]
            for t in range(1, longest):
                np.add((best[t - 1] + back[:, :, None]).max(1), e[t], out=best[t])
            leave = np.where(stretches[part, 3], 0, trans[:, 0][:, None])
            tag = np.zeros(len(part), np.int64)
            tags = np.zeros((longest, len(part)), np.int8)
            for t in range(longest - 1, -1, -1):
                ends, inside = t == lengths - 1, t < lengths - 1
                if ends.any():
                    tag = np.where(ends, (best[t] + leave).argmax(0), tag)
                if inside.any():
                    tag = np.where(inside, (best[t] + trans[:, tag]).argmax(0), tag)
                tags[t] = np.where(t < lengths, tag, 0)
            for row in np.flatnonzero(tags.any(0)):
                out[int(part[row])] = tags[: lengths[row], row]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Mentions of each text: (start, end, kind), from the left. Texts that are equal are read once."""
        once = {text: k for k, text in enumerate(dict.fromkeys(texts))}
        found = self._spans(list(once))
        return [found[once[text]] for text in texts]

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Some texts at a time, HELD characters or one text."""
        out: list[list[tuple[int, int, str]]] = []
        some: list[str] = []
        held = 0
        for text in texts:
            if some and held + len(text) > HELD:
                out += self._find(some)
                some, held = [], 0
            some.append(text)
            held += len(text)
        return out + self._find(some)

    def emissions(self, texts: list[str]) -> np.ndarray:
        """Scores of the tags at each character of all texts, one text after the other."""
        e = np.empty((sum(map(len, texts)), N_TAGS), np.float32)
        todo, at = [], 0  # window, where its own characters lie in it, where among all
        for text in texts:
            coded, cuts = encode(text), windows(len(text))
            todo += [(coded[a:b], lo - a, hi - a, at + lo) for (a, b), (lo, hi) in zip(cuts, owned(cuts), strict=True)]
            at += len(text)
        todo.sort(key=lambda w: len(w[0]))
        for at in range(0, len(todo), BATCH):
            part = todo[at : at + BATCH]
            scored = self.scores([w[0] for w in part])
            for row, (_, lo, hi, place) in enumerate(part):
                e[place : place + hi - lo] = scored[lo:hi, row]
        return e

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        e = self.emissions(texts)
        place = np.flatnonzero(~self.sure(e))
        if not len(place):
            return out
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, place, side="right")
        cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(text) > 0)) + 1
        from_, to = place[np.concatenate([[0], cut])], place[np.concatenate([cut - 1, [len(place) - 1]])] + 1
        text = text[np.concatenate([[0], cut])]
        first = (ends - sizes)[text]
        stretches = np.stack([from_, to, from_ == first, to == ends[text]], axis=1)
        for n, tags in sorted(self.decide(e, stretches).items()):
            out[text[n]] += to_spans(tags, int(from_[n] - first[n]))
        return out


def to_spans(tags: np.ndarray, at: int = 0) -> list[tuple[int, int, str]]:
    out, t, n = [], 0, len(tags)
    while t < n:
        if not tags[t]:
            t += 1
            continue
        kind, begin = (tags[t] - 1) // 2, t
        t += 1
        while t < n and tags[t] == 2 + 2 * kind:
            t += 1
        out.append((at + begin, at + t, KINDS[kind]))
    return out


def mentions(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row per mention: id, kind, nth (from the left, by kind), start, end in code points, text.

    Null, empty and blank contents have no mentions. Only the two named columns are read; a repeated row
    repeats its mentions. Texts of any length are read whole.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load()
        for batch in batches:
            rows = []
            texts = batch["content"].tolist()
            for key, text, found in zip(batch["id"], texts, tagger.spans(texts), strict=True):
                seen = dict.fromkeys(KINDS, 0)
                for a, b, kind in found:
                    seen[kind] += 1
                    rows.append((key, kind, seen[kind], a, b, text[a:b]))
            yield pd.DataFrame(rows, columns=["id", "kind", "nth", "start", "end", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("id"), F.col(content).alias("content")).filter("content IS NOT NULL AND content <> ''")
    return given.mapInPandas(find, f"id {kind}, kind string, nth int, start int, end int, text string")


def masked(content: Column) -> Column:
    """The text with each mention replaced by its kind in square brackets, [EMAIL] and so on; null stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        out = []
        for text, found in zip(given, Tagger.load().spans(given), strict=True):
            parts, at = [], 0
            for a, b, kind in found:
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, index=texts.index).where(texts.notna(), None)

    return mask(content)
