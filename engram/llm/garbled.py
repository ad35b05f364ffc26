"""Text that was read in a wrong encoding: expectation-maximization over latent encoding chains.

Every line with characters beyond ASCII has a hidden chain of misreadings (mostly the empty one). Its
evidence are its runs of such characters with their neighbours: for each chain, how much more probable
the run is once the chain is undone, by a character bigram model of the clean text that backs off to
scripts. A run of a clean line may also be cited ("`Ã©` was shown"): whether it is, is hidden as well.
Nothing of this is given: each round weights every line by its posterior (E), then counts anew (M) the
chains per source and field, the bigrams of what the lines really say, how long runs are and where they
stand, how often and after which words characters are cited. So weak evidence in one record, a
lone accent, is settled by what is known of its source. Rounds go on until the share of garbled lines and
chains settle within TOLERANCE. All lines of all texts take part in all rounds.

What crosses to the driver is of fixed size: counts of BUCKETS hashed bigrams, 65,536 characters and as
many hashed words. Shares per source and field stay a table; it is handed to the tasks whole where it has
at most FEW_GROUPS rows and is joined to the lines otherwise.
"""

import functools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch
from engram.plans.skew import hot_keys, join_unique

BUCKETS, FEW_GROUPS, PRIOR, OPEN = 1 << 18, 4096, 0.002, 0.3
#: Rounds end when the expected number of lines of no chain changes by less than this share of all lines garbled (or of
#: one line); more than MOST rounds are an error of the model and are said so.
TOLERANCE, MOST = 0.002, 40
#: Doubtful lines teach the model of clean text less than their posterior, by this power of it, so that they cannot hold
#: each other up as clean.
DOUBT = 3
#: In the first round runs that undo as UTF-8, which clean text seldom holds by chance, teach by this weight for each
#: character that they undo to.
CHANCE = 0.02
#: Log-odds lost for a run that a chain could not have made, and the floor and ceiling of one run's evidence.
IMPOSSIBLE, CEILING = -12.0, 25.0
#: A lost character under the chains that lose characters has this log-probability.
LOST = math.log(0.05)
#: Shares of a line's runs that its chain may have made where it made not all of them, and how probable it is that it made all.
PARTS, ALL = np.array([0.9, 0.5, 0.1, 0.01, 0.001]), 0.5
ALPHA = 2.0
CLEAN, LOSSY = "", "lost"
#: Where a run stands: in or at a word, alone, or in quotes of its own.
EMBEDDED, ALONE, ENCLOSED = 0, 1, 2
#: How often a line cites a run of each place before anything is known (never in a word); how rarely a citation has one character more (what is
#: cited is a character, as a rule, not a word); how many words there are that may stand before a lone run.
CITED, LONGER, VOCABULARY = (0.0, 0.002, 0.005), 0.001, 20_000

RUN = re.compile(r"[^\x00-\x7f]+")
_OPEN, _CLOSE = "“„‘«‚\"'`", "”“’»‘\"'`"
_QUOTES = "“”„‘’‚«»"


@functools.cache
def to_byte(charset: str) -> dict[str, int]:
    """Character to byte of a one-byte charset; what the charset leaves undefined stands for itself, as readers do."""
    table = {}
    for b in range(255, 127, -1):
        table[chr(b)] = b
    if charset != "cp1252":
        table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


def _bytes(text: str, charset: str) -> bytes | None:
    table = to_byte(charset)
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in text)
    except KeyError:
        return None


#: Each step is (how the bytes were read, what they really were); a chain lists its steps, the last misreading first.
STEPS = {
    "utf8>1252": (("cp1252", "utf-8"),),
    "utf8>1252 twice": (("cp1252", "utf-8"), ("cp1252", "utf-8")),
    "utf8>1252 thrice": (("cp1252", "utf-8"),) * 3,
    "utf8>mac": (("mac_roman", "utf-8"),),
    "utf8>437": (("cp437", "utf-8"),),
    "utf8>850": (("cp850", "utf-8"),),
    "utf8>1251": (("cp1251", "utf-8"),),
    "utf8>1250": (("cp1250", "utf-8"),),
    "utf8>mac twice": (("mac_roman", "utf-8"),) * 2,
    "utf8>437 twice": (("cp437", "utf-8"),) * 2,
    "1252>mac": (("mac_roman", "cp1252"),),
    "1252>437": (("cp437", "cp1252"),),
    "1252>850": (("cp850", "cp1252"),),
    "1252>1251": (("cp1251", "cp1252"),),
    "mac>1252": (("cp1252", "mac_roman"),),
    "437>1252": (("cp1252", "cp437"),),
    "949>1252": (("cp1252", "cp949"),),
    "949>mac": (("mac_roman", "cp949"),),
    "utf8>949": (("cp949", "utf-8"),),
}
CHAINS = (CLEAN, *STEPS, LOSSY)


def undo(run: str, chain: str) -> str | None:
    """The run before the chain's misreadings, or None if they cannot have made it."""
    for read, real in STEPS[chain]:
        try:
            raw = run.encode("cp949") if read == "cp949" else _bytes(run, read)
            if raw is None:
                return None
            out = raw.decode(real)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        if out == run:
            return None
        run = out
    return run if not any("\x80" <= c < "\xa0" for c in run) else None


@functools.lru_cache(200_000)
def undone(run: str) -> tuple[tuple[int, str], ...]:
    """The chains that can have made a run, by number, with what it was before."""
    return tuple((k, real) for k, chain in enumerate(CHAINS[1:-1], 1) if (real := undo(run, chain)) is not None)


_UTF8 = frozenset(k for k, chain in enumerate(CHAINS[1:-1], 1) if STEPS[chain][0][1] == "utf-8")


def was_utf8(run: str) -> int:
    """To how many characters some charset undoes the run as UTF-8 (the most), 0 if none does."""
    return max((len(real) for k, real in undone(run) if k in _UTF8), default=0)


@functools.cache
def scripts() -> np.ndarray:
    """Script of each character of the basic plane, for the model's backing off."""
    table = np.full(65536, 8, np.int8)
    for lo, hi, script in ((0xC0, 0x250, 0), (0x1E00, 0x1F00, 0), (0xAC00, 0xD7A4, 1), (0x1100, 0x1200, 1), (0x3040, 0x3100, 2), (0x3400, 0xA000, 2), (0xF900, 0xFB00, 2), (0x400, 0x530, 3), (0x370, 0x400, 4), (0x80, 0xA0, 10), (0xA0, 0xC0, 11), (0x2010, 0x2028, 12), (0x2028, 0x2C00, 11)):
        table[lo:hi] = script
    for cp in range(128):
        c = chr(cp)
        table[cp] = 0 if c.isalpha() else 6 if c.isdigit() else 5 if c.isspace() else 7
    table[[0xD7, 0xF7]] = 11
    table[[0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF]] = 12
    table[0xFFFD] = 9
    return table


N_SCRIPTS = 13
#: So many characters of a script are thought possible at most.
POSSIBLE = 500
#: Transitions between scripts that count as seen beforehand: letters of one script keep together, marks go with all.
_BEFORE = np.full((N_SCRIPTS, N_SCRIPTS), 0.2)
_BEFORE[:, 5:8] = 20.0
_BEFORE[5:8, :5] = 20.0
_BEFORE[:, 8] = _BEFORE[8, :] = 2.0
_BEFORE[:, 11] = _BEFORE[11, :] = 1.0
_BEFORE[5:8, 11] = _BEFORE[11, 5:8] = _BEFORE[:, 12] = _BEFORE[12, :] = 20.0
_BEFORE[range(5), range(5)] = 200.0
_BEFORE[:, 9:11] = 0.05


class Model:
    """Character bigrams, hashed; log-probabilities back off to single characters of the next character's script.

    Every bigram and character counts once less than it was seen, so that no text is known by itself alone.
    """

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, moves: np.ndarray):
        table = scripts()
        size, seen = np.minimum(np.bincount(table, minlength=N_SCRIPTS), POSSIBLE), np.bincount(table, weights=singles, minlength=N_SCRIPTS)
        within = (np.maximum(singles - 1, 0) + 0.05) / (seen + 0.05 * size)[table]
        moves = moves.reshape(N_SCRIPTS, N_SCRIPTS) + _BEFORE
        self.pairs, self.singles, self.within, self.moves, self.table = np.maximum(pairs - 1, 0), singles, within, moves / moves.sum(1, keepdims=True), table

    def log_p(self, texts: Sequence[str]) -> np.ndarray:
        """Of each text but its first character, given that; texts have two characters or more."""
        a, b, starts = pairs_of(texts)
        back = self.moves[self.table[a], self.table[b]] * self.within[b]
        p = np.log((self.pairs[hashed(a, b)] + ALPHA * back) / (self.singles[a] + ALPHA))
        return np.add.reduceat(p, starts)


def pairs_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second characters of the bigrams of all texts, cut to 16 bits, and where each text's begin."""
    points = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    inner = np.ones(len(points) - 1, bool)
    inner[ends[:-1] - 1] = False
    at = np.flatnonzero(inner)
    return points[at], points[at + 1], ends - sizes - np.arange(len(texts))


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B)) >> 5 & (BUCKETS - 1)


@functools.lru_cache(200_000)
def pieces(run: str) -> tuple[str, ...]:
    """A run, or its quotes at both ends apart from what they enclose, where only that can have been UTF-8 (or any chain's)."""
    core = run.strip(_QUOTES)
    if not core or core == run or was_utf8(run) or undone(run) and not was_utf8(core):
        return (run,)
    lead = len(run) - len(run.lstrip(_QUOTES))
    return tuple(p for p in (run[:lead], core, run[lead + len(core) :]) if p)


def found(line: str) -> list[tuple[int, int]]:
    """Where the runs of a line stand."""
    out = []
    for m in RUN.finditer(line):
        at = m.start()
        for piece in pieces(m.group()):
            out.append((at, at + len(piece)))
            at += len(piece)
    return out


def items(line: str) -> list[str]:
    """Runs with what matters of their surroundings: place, hash of the word before a lone run, neighbours and run, in one string."""
    out = []
    for i, j in found(line):
        a, b = line[i - 1] if i else " ", line[j] if j < len(line) else " "
        place, word = EMBEDDED, 0
        if a in _OPEN and b in _CLOSE or j - i > 2 and line[i] in _OPEN and line[j - 1] in _CLOSE:
            place = ENCLOSED
        elif not (a.isalnum() or b.isalnum() or a > "\x7f" or b > "\x7f"):
            place = ALONE
            before = line[max(0, i - 40) : i].rsplit(None, 1)
            word = zlib.crc32(before[-1].lower().strip("“\"'`:(").encode("utf-8", "replace")) & 0xFFFF if before else 0
        a, b = ("0" if c.isdigit() else " " if c.isspace() else c for c in (a, b))
        out.append(f"{place}{word:04x}{a}{line[i:j]}{b}")
    return out


def _mixed(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each chain against a clean line, from its gains by run and chain, and how probably each run is the chain's.

    Either the chain made all runs, or each run is its own choice between the chain and clean, at a share out of PARTS; at
    least one run is the chain's.
    """
    n = len(gains)
    part = PARTS[:, None, None]
    each = np.log1p(part / (1 - part) * np.exp(gains))
    none = n * np.log1p(-PARTS)[:, None]
    total = each.sum(1)
    # log(exp(total) - 1), whether total is tiny or huge
    some = np.where(total > 30, total, np.log(np.expm1(np.minimum(total, 30)) + 1e-300))
    ways = np.concatenate([gains.sum(0)[None] + math.log(ALL), none + some - np.log(-np.expm1(none)) + math.log((1 - ALL) / len(PARTS))])
    most = ways.max(0)
    weights = np.exp(ways - most)
    weights /= weights.sum(0)
    made = weights[0] + (weights[1:, None] * -np.expm1(-each)).sum(0)
    return most + np.log(np.exp(ways - most).sum(0)), made


class State:
    """What a round knows: hashed bigrams, characters, moves between scripts, places and lengths of clean runs, citations, lines."""

    def __init__(self, counts: dict[str, np.ndarray] | None = None):
        sizes = {"pairs": BUCKETS, "singles": 65536, "moves": N_SCRIPTS**2, "places": 12, "cited": 3, "cited words": 65536, "clean words": 65536, "lines": 2}
        self.n = {k: np.zeros(size) if counts is None or k not in counts else counts[k] for k, size in sizes.items()}

    def model(self) -> Model:
        return Model(self.n["pairs"], self.n["singles"], self.n["moves"])

    def rows(self) -> list[tuple[str, str, float]]:
        return [(what, str(k), float(n[k])) for what, n in self.n.items() for k in np.flatnonzero(n)]

    def teach(self, texts: Sequence[str], weights: np.ndarray) -> None:
        """Clean text; a lost character is never clean, so it is not learnt."""
        if not len(texts):
            return
        a, b, starts = pairs_of(texts)
        w = np.repeat(weights, np.diff(np.append(starts, len(a))))
        w = np.where((a == 0xFFFD) | (b == 0xFFFD), 0, w)
        table = scripts()
        self.n["pairs"] += np.bincount(hashed(a, b), w, BUCKETS)
        self.n["singles"] += np.bincount(a, w, 65536)
        last = np.array([ord(t[-1]) & 0xFFFF for t in texts])
        self.n["singles"] += np.bincount(last, np.where(last == 0xFFFD, 0, weights), 65536)
        self.n["moves"] += np.bincount(table[a].astype(np.int64) * N_SCRIPTS + table[b], w, N_SCRIPTS**2)


class Judge:
    """Posteriors of lines under one state, and the counts that they give the next one."""

    #: Different runs that are remembered at a time.
    KNOWN = 200_000

    def __init__(self, state: State, shares: dict[str, np.ndarray] | None, prior: float = PRIOR):
        self.model, self.shares, self.prior, self.next = state.model(), shares, prior, State()
        n = state.n
        self.places = np.log((n["places"] + 1) / (n["places"].sum() + 12))
        self.cited = np.log((n["cited"] + 1000 * np.array(CITED)) / (n["lines"].sum() + 1000) + 1e-30)
        word = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * VOCABULARY))
        self.words = word(n["cited words"]) - word(n["clean words"])
        self.groups: dict[str, np.ndarray] = {}
        self.priors: dict[str, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.gains, self.quoted = np.zeros((0, len(CHAINS))), np.zeros(0)
        self.weights, self.cites = np.zeros(0), np.zeros(0)

    def learn(self, new: list[str]) -> None:
        """Evidence of runs that were not met before: log-odds of each chain against a clean line, and of being cited."""
        n = len(new)
        place = np.array([int(t[0]) for t in new])
        word = np.array([int(t[1:5], 16) for t in new])
        size = np.array([len(t) - 7 for t in new])
        texts, owner, chain = [t[5:] for t in new], [], []
        for k, t in enumerate(new):
            for c, real in undone(t[6:-1]):
                owner.append(k)
                chain.append(c)
                texts.append(t[5] + real + t[-1])
        p = self.model.log_p(texts)
        owner, chain = np.array(owner, np.int64), np.array(chain, np.int64)
        lost = np.array([k for k, t in enumerate(new) if "�" in t[6:-1]], np.int64)
        # what each chain, or a loss, says of a run: its log-probability, and how long it really is
        said = np.concatenate([p[n:], LOST * size[lost]])
        real = np.concatenate([np.array([len(t) - 2 for t in texts[n:]], np.int64), size[lost]])
        owner, chain = np.concatenate([owner, lost]), np.concatenate([chain, np.full(len(lost), len(CHAINS) - 1)])
        where = lambda at, long: self.places[at * 4 + np.minimum(long, 4) - 1]
        clean = p[:n] + where(place, size)
        cite = self.cited[place[owner]] + (real - 1) * math.log(LONGER) + np.where(place[owner] == ALONE, self.words[word[owner]], 0) + said
        most = np.full(n, -np.inf)
        np.maximum.at(most, owner, cite)
        stands = np.logaddexp(clean, most)
        gains = np.full((n, len(CHAINS)), IMPOSSIBLE)
        gains[:, 0], gains[:, -1] = 0, IMPOSSIBLE / 4
        gains[owner, chain] = np.clip(said + where(place[owner], real) - stands[owner], IMPOSSIBLE, CEILING)
        start = len(self.at)
        self.at |= {t: start + k for k, t in enumerate(new)}
        self.gains = np.concatenate([self.gains, gains])
        self.quoted = np.concatenate([self.quoted, np.exp(most - stands)])
        self.weights, self.cites = np.concatenate([self.weights, np.zeros(n)]), np.concatenate([self.cites, np.zeros(n)])

    def prior_of(self, group: str, shares=None) -> np.ndarray:
        """Log shares of the chains in a group, smoothed by the prior."""
        if group not in self.priors:
            start = np.full(len(CHAINS), self.prior / (len(CHAINS) - 1))
            start[0] = 1 - self.prior
            seen = np.asarray(shares) if shares is not None else (self.shares or {}).get(group)
            if len(self.priors) > 100_000:
                self.priors.clear()
            self.priors[group] = np.log(start if seen is None else (seen + 200.0 * start) / (seen.sum() + 200.0))
        return self.priors[group]

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """Posterior of the chains of each line, and of garbled ones which runs the likeliest chain made; counts them."""
        if not batch.num_rows:
            return np.zeros((0, len(CHAINS))), []
        names, number, sizes = unpacked(batch)
        at = self.places_of(names)[number]
        starts = np.cumsum(sizes) - sizes
        groups = batch.column("group").dictionary_encode()
        group, named = groups.indices.to_numpy(), groups.dictionary.to_pylist()
        given = [None] * len(named)
        if "shares" in batch.schema.names:
            firsts = np.unique(group, return_index=True)[1]
            given = batch.column("shares").take(pa.array(firsts)).to_pylist()
        prior = np.stack([self.prior_of(g, s) for g, s in zip(named, given, strict=True)])[group]
        gains = self.gains[at]
        score = prior + np.add.reduceat(gains, starts)
        # no mixture gives more than the sum of the gains of the runs that speak for a chain
        worth = np.add.reduceat(np.maximum(gains, 0), starts) + prior > prior[:, :1] - 3
        worth[:, 0] = False
        partly: dict[int, dict[int, np.ndarray]] = {}
        for k in np.flatnonzero(worth.any(1) & (sizes > 1)):
            chains = np.flatnonzero(worth[k])
            odds, parts = _mixed(gains[starts[k] : starts[k] + sizes[k], chains])
            score[k, chains] = prior[k, chains] + odds
            partly[k] = {int(c): parts[:, n] > 0.5 for n, c in enumerate(chains)}
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        best = p[:, 1:].argmax(1) + 1
        wrong = np.ones(len(at), bool)
        for k, parts in partly.items():
            if int(best[k]) in parts:
                wrong[starts[k] : starts[k] + sizes[k]] = parts[int(best[k])]
        clean, quoted = np.repeat(p[:, 0], sizes), self.quoted[at]
        self.weights += np.bincount(at, np.where(wrong, clean**DOUBT, 1.0) * (1 - quoted), len(self.weights))
        self.cites += np.bincount(at, clean * quoted, len(self.cites))
        texts, weights = [], []
        for k in np.flatnonzero((p[:, 0] < 0.5) & (best < len(CHAINS) - 1)):
            for n in range(starts[k], starts[k] + sizes[k]):
                item = names[number[n]]
                if wrong[n] and (real := undo(item[6:-1], CHAINS[best[k]])):
                    texts.append(item[5] + real + item[-1])
                    weights.append(p[k, best[k]])
        self.next.teach(texts, np.array(weights))
        self.next.n["lines"] += [p[:, 0].sum(), p[:, 1:].sum()]
        for n, name in enumerate(named):
            self.groups[name] = self.groups.get(name, 0) + p[group == n].sum(0)
        return p, [wrong[starts[k] : starts[k] + sizes[k]] if p[k, 0] < 0.5 else None for k in range(len(p))]

    def places_of(self, names: list[str]) -> np.ndarray:
        """Where the runs are remembered; new ones are learnt."""
        if len(self.at) > self.KNOWN:
            self.settle()
        if new := [t for t in names if t not in self.at]:
            self.learn(new)
        return np.array([self.at[t] for t in names], np.int64)

    def settle(self) -> None:
        """Count what the remembered runs have gathered, and forget them."""
        n, all_ = self.next.n, list(self.at)
        if all_:
            self.next.teach([t[5:] for t in all_], self.weights)
            place, size = np.array([int(t[0]) for t in all_]), np.array([len(t) - 7 for t in all_])
            word = np.array([int(t[1:5], 16) for t in all_])
            n["places"] += np.bincount(place * 4 + np.minimum(size, 4) - 1, self.weights, 12)
            n["cited"] += np.bincount(place, np.where(place == EMBEDDED, 0, self.cites), 3)
            alone = place == ALONE
            n["cited words"] += np.bincount(word[alone], self.cites[alone], 65536)
            n["clean words"] += np.bincount(word[alone & (size == 1)], self.weights[alone & (size == 1)], 65536)
        self.reset()

    def rows(self) -> pa.RecordBatch:
        self.settle()
        out = self.next.rows() + [(f"of {g}", str(k), float(v)) for g, shares in self.groups.items() for k, v in enumerate(shares) if v > 0]
        what, at, n = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(at, pa.string()), pa.array(n, pa.float64())], names=["what", "at", "n"])


def unpacked(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different items of a batch of lines, which of them each run is, and how many runs each line has."""
    column = batch.column("items")
    coded = column.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(column.offsets.to_numpy())


def lines_of(df: DataFrame, key: str, source: str | None, fields: Sequence[str]) -> DataFrame:
    """Lines with characters beyond ASCII: key, field, nth, line, group (the source and field) and items (see there)."""
    parts = []
    for field in fields:
        from_ = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")) if source else F.lit("")
        lines = df.select(F.col(key).alias("key"), F.lit(field).alias("field"), F.concat(F.lit(f"{field}:"), from_).alias("group"), F.posexplode(F.split(F.col(field), "\n")).alias("nth", "line"))
        parts.append(lines.filter(F.col("line").rlike(r"[^\x00-\x7f]")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    kind = out.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([items(line) for line in batch.column("line").to_pylist()], pa.list_(pa.string()))
            names = ["key", "field", "group", "nth", "line"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), found], names=[*names, "items"])

    return out.mapInArrow(parse, f"key {kind}, field string, group string, nth int, line string, items array<string>")


class Shares:
    """Counts of chains by group: in the tasks' hands where groups are few, joined to the lines where they are many."""

    def __init__(self, counted: DataFrame):
        of = counted.filter("what LIKE 'of %'").select(F.expr("substring(what, 4)").alias("group"), F.col("at").cast("int").alias("at"), "n")
        entries = F.map_from_entries(F.collect_list(F.struct("at", "n")))  # one entry for each chain
        dense = F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) for k in range(len(CHAINS))))
        self.table = of.groupBy("group").agg(entries.alias("m")).select("group", dense.alias("shares"))
        some = self.table.limit(FEW_GROUPS + 1).collect()
        self.few = {r["group"]: np.array(r["shares"]) for r in some} if len(some) <= FEW_GROUPS else None

    def beside(self, lines: DataFrame, rows: int) -> DataFrame:
        if self.few is not None:
            return lines
        hot = hot_keys(lines.groupBy("group").agg(F.count("*").alias("n")), "group", "n", rows)
        return join_unique(lines, self.table, "group", hot)


def _estimate(lines: DataFrame, scratch: Scratch) -> tuple[State, Shares | None, int]:
    """State and shares after the last round, and the number of lines.

    In the first round runs that undo as UTF-8 count for little; in the second lines are judged with an open mind (OPEN).
    """
    kind, spark = "what string, at string, n double", scratch.spark

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(State(), None)
        for batch in batches:
            names, number, _ = unpacked(batch)
            if not names:
                continue
            at = judge.places_of(names)
            times = np.bincount(number, minlength=len(names))
            judge.weights += np.bincount(at, times * np.array([CHANCE ** was_utf8(t[6:-1]) for t in names]), len(judge.weights))
            judge.next.n["lines"][0] += batch.num_rows
        yield judge.rows()

    def judged(state: State, shares: Shares | None, prior: float):
        held = spark.sparkContext.broadcast((state, None if shares is None else shares.few))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Judge(*held.value, prior)
            for batch in batches:
                judge(batch)
            yield judge.rows()

        return count

    def totals(counted: DataFrame) -> tuple[State, DataFrame]:
        """The sums of a round; those of fixed number come to the driver."""
        sums = scratch.write(counted.groupBy("what", "at").agg(F.sum("n").alias("n")))
        state = State()
        for what, part in sums.filter("what NOT LIKE 'of %'").toPandas().groupby("what"):
            state.n[what][part["at"].astype(int).to_numpy()] = part["n"].to_numpy()
        return state, sums

    state, old = totals(lines.mapInArrow(begin, kind))
    scratch.drop(old)
    rows, shares, before, counted = int(round(state.n["lines"].sum())), None, -1.0, None
    for turn in range(MOST):
        given = lines if shares is None else shares.beside(lines, rows)
        state, sums = totals(given.mapInArrow(judged(state, shares, PRIOR if turn else OPEN), kind))
        shares = Shares(sums)
        if counted is not None:
            scratch.drop(counted)
        counted = sums
        garbled = float(state.n["lines"][1])
        if turn > 1 and abs(garbled - before) <= max(0.05, TOLERANCE * garbled):
            return state, shares, rows
        before = garbled
    raise RuntimeError(f"the rounds have not settled after {MOST}: {before} garbled lines, then {garbled}")


def garbled_lines(df: DataFrame, key: str, source: str | None, fields: Sequence[str]) -> DataFrame:
    """Lines that were read in a wrong encoding: key, field, nth, line, chain, probability, restored.

    restored is null where characters are lost for good. Null and empty texts have no such lines;
    repeated rows repeat theirs; an empty table gives no rows. Other columns are not read. The rounds run when this is
    called.
    """
    scratch = Scratch(df.sparkSession)
    lines = scratch.write(lines_of(df, key, source, fields))
    state, shares, rows = _estimate(lines, scratch)
    known = df.sparkSession.sparkContext.broadcast((state, shares.few))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*known.value)
        for batch in batches:
            p, made = judge(batch)
            at = np.flatnonzero(p[:, 0] < 0.5)
            some = batch.take(pa.array(at, pa.int64()))
            chains = [CHAINS[int(p[k, 1:].argmax()) + 1] for k in at]
            restored = [restore(line, chain, made[k]) for line, chain, k in zip(some.column("line").to_pylist(), chains, at)]
            names = ["key", "field", "nth", "line"]
            yield pa.RecordBatch.from_arrays(
                [*(some.column(name) for name in names), pa.array(chains, pa.string()), pa.array(1 - p[at, 0], pa.float64()), pa.array(restored, pa.string())], names=[*names, "chain", "probability", "restored"]
            )

    kind = lines.schema["key"].dataType.simpleString()
    return shares.beside(lines, rows).mapInArrow(decide, f"key {kind}, field string, nth int, line string, chain string, probability double, restored string")


def restore(line: str, chain: str, made: Sequence[bool]) -> str | None:
    """The line with every run undone that the chain made, as far as it can have; None where characters are lost."""
    if chain == LOSSY or "�" in line:
        return None
    out, at = [], 0
    for (i, j), wrong in zip(found(line), made, strict=True):
        out += [line[at:i], (undo(line[i:j], chain) if wrong else None) or line[i:j]]
        at = j
    return "".join([*out, line[at:]])
