"""Token ids of a public byte-level BPE vocabulary, by dynamic programming over prefixes.

Every prefix of a word has exactly one token that its encoding can end with. Walking the word from
the left, the last token of each prefix is the one token ending there that fits behind the last token
of the prefix before it. The table of last tokens is the whole state: the ids are read off backwards,
more bytes can be appended exactly without looking at the rest again, and after an edit only the words
around it are encoded anew.

Whether two tokens fit side by side follows from the order of the merges: they do unless some pair
across their border would have been merged while both of its halves stood next to the border.
"""

import base64
import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies: a file of base64 tokens and ranks, at the same path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of words of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its known words beyond this many.
KNOWN = 400_000
#: Ids that are held before they are handed on.
FLUSH = 2_000_000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS):
        self.ranks = ranks
        self.texts = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.sides: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str = VOCABULARY) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def split(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token; (token, -1) for single bytes, None if merging its bytes does not give it."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.texts[token]]
            pair = (token, -1)
            while len(parts) > 1:
                joined = [self.ranks.get(self.texts[a] + self.texts[b], token + 1) for a, b in zip(parts, parts[1:])]
                best = min(joined)
                if best > token:
                    break
                k = joined.index(best)
                pair = (parts[k], parts[k + 1])
                parts[k : k + 2] = [best]
            self.halves[token] = pair if len(parts) == 1 else None
        return self.halves[token]

    def border(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one end (0 left, 1 right) while the token is made, each with the rank that ends it."""
        if (token, side) not in self.sides:
            out, now, until = [], token, float("inf")
            while True:
                out.append((now, until))
                pair = self.split(now)
                if pair is None or pair[1] < 0:
                    break
                now, until = pair[side], now
            self.sides[token, side] = out
        return self.sides[token, side]

    def fit(self, left: int, right: int) -> bool:
        """Whether left and right can be neighbours. Equal merges go from the left, so a tie is lost only on the right."""
        known = self.fitting.get((left, right))
        if known is None:
            known = True
            for a, end_a in self.border(left, 1):
                for b, end_b in self.border(right, 0):
                    rank = self.ranks.get(self.texts[a] + self.texts[b])
                    if rank is not None and rank < end_a and rank <= end_b and self.split(rank) == (a, b):
                        known = False
            if len(self.fitting) > 2_000_000:
                self.fitting.clear()
            self.fitting[left, right] = known
        return known

    def extend(self, word: bytes, last: list[int]) -> list[int]:
        """last, the last tokens of the first len(last) prefixes of the word, carried on to all of them."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(word[start:end])
                if token is not None and self.split(token) is not None and (start == 0 or self.fit(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def read(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.texts[last[at - 1]])
        return out[::-1]

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            raw = word.encode("utf-8", "surrogatepass")
            direct = self.ranks.get(raw)
            ids = [direct] if direct is not None and self.split(direct) is not None else self.read(self.extend(raw, []))
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words.findall(text):
            out += self.word(word)
        return out


class Encoded:
    """A text with its ids by word, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.words: list[list[int]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for word in self.words for i in word]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> int:
        """Put new in place of text[begin:end]; gives the number of words that were encoded anew.

        A word depends on its own characters and one beyond, so encoding starts two words before the edit
        and ends where a word begins that began there before, more than a word behind it.
        """
        text = self.text[:begin] + new + self.text[end:]
        moved = len(new) - (end - begin)
        keep = max(0, sum(s <= begin for s in self.starts) - 3)
        at = self.starts[keep] if self.starts else 0
        old = {s + moved: k for k, s in enumerate(self.starts) if s >= end}
        starts, words, behind = [], [], 0
        rest: int | None = None
        for m in self.vocabulary.words.finditer(text, at):
            if m.start() in old and m.start() >= begin + len(new):
                behind += 1
                if behind > 2:
                    rest = old[m.start()]
                    break
            starts.append(m.start())
            words.append(self.vocabulary.word(m.group()))
        tail_starts = [s + moved for s in self.starts[rest:]] if rest is not None else []
        tail_words = self.words[rest:] if rest is not None else []
        self.starts = self.starts[:keep] + starts + tail_starts
        self.words = self.words[:keep] + words + tail_words
        self.text = text
        return len(words)


def token_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """One row per row: the key and ids, the token ids of the whole text, without special tokens.

    Their spelling inside a text is ordinary text. Null and empty texts have the empty list; repeated rows
    come out as often as they come in; no other column is read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            keys, at, flat, offsets = batch.column(0), 0, array("i"), [0]
            for n, value in enumerate(batch.column(1), 1):
                given = value.as_py()
                if given:
                    flat.extend(vocabulary.encode(given))
                offsets.append(len(flat))
                # long texts: no more than FLUSH ids are held besides those of one text
                if len(flat) > FLUSH or n == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, n - at), ids], names=[key, "ids"])
                    at, flat, offsets = n, array("i"), [0]

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
