"""The k most similar vectors of every vector, by additive quantisation and exact reranking.

A vector is written as a sum of STAGES full-dimensional codewords, one per residual codebook, found by
beam search; the norm of the sum is stored beside the codes. Cells are groups of about CROWD vectors,
so their number follows the collection: first codes that more vectors share are divided by centres
fitted on their own vectors. Every vector is filed in the nearest cells until they hold LOOK vectors
and are at least CELLS of them, and is compared with all vectors that are filed in one of the same; two
neighbours miss each other only where they share none of several cells. In blocks of more than RERANK
vectors, candidates are scored with tables of the query's products with all codewords, divided by the
stored norms, and the best RERANK are measured exactly; in smaller ones all are. All four numbers are
arguments; with exact=True there is one cell and all are measured, which is the true answer at
quadratic cost.

Cells are at most WORDS * WORDS; up to some CROWD * WORDS * WORDS vectors (8 million) they keep their
size, beyond that they grow with the collection.

Codebooks are fitted on a bounded sample (SAMPLE vectors, lowest hash of the id first), centres on some
FIT vectors for each, in tasks of bounded size; every vector is indexed. A cell is cut into blocks of
vectors and blocks of lookers, so no group grows with the crowd in a cell, and nothing but codebooks,
centres and cell sizes (at most WORDS * WORDS) leaves the executors.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.lineage import Scratch

SAMPLE, STAGES, WORDS, BEAM = 20_000, 8, 256, 4
#: What top_similar() takes by default: vectors and cells that each vector looks through at least, cells at most, candidates
#: of a block that are measured exactly.
LOOK, CELLS, NEAR, RERANK = 600, 5, 256, 1024
#: First codes with more vectors than CROWD are divided into cells of about as many. Blocks are of about BLOCK vectors; small
#: cells are handed on together, about PACK vectors at a time.
CROWD, BLOCK, PACK = 128, 4096, 16_384
#: Vectors that a centre is fitted on, vectors of a task that fits, first codes of which the centres are measured.
FIT, FITTED, FIRST = 32, 32_768, 32
#: What a vector does in a block.
BOTH, FOUND, LOOKS = 0, 1, 2
#: More than float32 products of unit vectors are wrong by.
SLACK = 4e-6


def fit_codebooks(x: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Residual codebooks, stages x words x dimensions, by k-means on what the earlier stages leave."""
    rng = np.random.default_rng(seed)
    rest, books = x.copy(), []
    words = min(words, len(x))
    for _ in range(stages):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = nearest(rest, book)
            order = np.argsort(near, kind="stable")
            firsts = np.flatnonzero(np.diff(near[order], prepend=-1))
            used = near[order][firsts]
            sums = np.add.reduceat(rest[order], firsts, axis=0)
            book[used] = sums / np.diff(np.append(firsts, len(rest)))[:, None]
            idle = np.setdiff1d(np.arange(words), used)
            if len(idle):
                book[idle] = rest[rng.choice(len(rest), len(idle))]
        rest = rest - book[nearest(rest, book)]
        books.append(book)
    return np.stack(books).astype(np.float32)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * (x @ book.T)).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x stages) and norms of their sums, by beam search over the stages."""
    n = len(x)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :]
    for book in books:
        cost = (book * book).sum(1) - 2 * (rest @ book.T) + (rest * rest).sum(2, keepdims=True)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        way, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, way], word[:, :, None].astype(np.uint8)], 2)
        rest = rest[rows, way] - book[word]
    best = (rest * rest).sum(2).argmin(1)
    rows = np.arange(n)
    made = x - rest[rows, best]
    return codes[rows, best], np.sqrt((made * made).sum(1)).astype(np.float32)


def usable_vectors(df: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """id and v, the usable vectors, each id once.

    Usable is a vector of exactly `size` finite numbers that are not all zero. Rows without an id are left
    out. If an id comes with several usable vectors, the smallest counts.
    """
    v = F.col("v")
    good = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = df.schema[vector].dataType.simpleString()
    given = df.select(F.col(id_col).alias("id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return given.filter(F.col("id").isNotNull() & v.isNotNull()).filter(good).groupBy("id").agg(F.min("v").alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in float64."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def upto(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def salts(ids: pd.Series) -> np.ndarray:
    """A non-negative number per id that only depends on the id."""
    return (pd.util.hash_array(ids.to_numpy(dtype=object).astype(str).astype(object)) >> np.uint64(1)).astype(np.int64)


def fit_centres(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of n cells and how many vectors of x are nearest to each; cells without any are left out."""
    book = fit_codebooks(x, stages=1, words=n)[0]
    near = np.concatenate([nearest(x[at : at + 4096], book) for at in range(0, len(x), 4096)])
    held = np.bincount(near, minlength=len(book))
    return book[held > 0], held[held > 0]


class Places:
    """Cells by their centres, and who is filed where: in the nearest cells until they hold `look` vectors, by estimated sizes,
    and are at least `few`, at most `near`.

    Where there are very many cells, only those of the nearest FIRST of the groups are measured.
    """

    FLAT = 8192

    def __init__(self, heads: np.ndarray, groups: np.ndarray, centres: np.ndarray, sizes: np.ndarray, look: int, few: int, near: int):
        order = np.argsort(groups, kind="stable")
        self.look, self.few, self.near = look, few, near
        self.centres, self.sizes = centres[order].astype(np.float32), sizes[order].astype(np.float64)
        self.half = (self.centres * self.centres).sum(1) / 2
        kinds, first = np.unique(groups[order], return_index=True)
        self.heads, self.bounds = heads[kinds], np.append(first, len(order))

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The nearest `most` cells of each row, nearest first."""
        if len(self.centres) <= self.FLAT:
            far, cell = self.half - x @ self.centres.T, None
        else:
            far, cell = self.some(x, most)
        if far.shape[1] > most:
            at = np.argpartition(far, most - 1, axis=1)[:, :most]
            at = np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), axis=1, kind="stable"), 1)
        else:
            at = np.argsort(far, axis=1, kind="stable")
        return at if cell is None else np.take_along_axis(cell, at, 1)

    def some(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        heads = (self.heads * self.heads).sum(1) / 2 - x @ self.heads.T
        n = min(FIRST, heads.shape[1])
        groups = np.argpartition(heads, n - 1, axis=1)[:, :n].ravel()
        by = np.argsort(groups, kind="stable")
        most = min(most, int(np.diff(self.bounds).max()))
        far, cell = np.full((len(groups), most), np.inf, np.float32), np.zeros((len(groups), most), np.int64)
        ends = np.searchsorted(groups[by], np.arange(len(self.heads) + 1))
        for g, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            rows = by[ends[g] : ends[g + 1]]
            if not len(rows):
                continue
            here = self.half[a:b] - x[rows // n] @ self.centres[a:b].T
            at = np.argpartition(here, most - 1, axis=1)[:, :most] if most < b - a else np.tile(np.arange(b - a), (len(rows), 1))
            far[rows, : at.shape[1]] = np.take_along_axis(here, at, 1)
            cell[rows, : at.shape[1]] = a + at
        return far.reshape(len(x), -1), cell.reshape(len(x), -1)

    def looks(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells of each row of x, in ascending order."""
        out, most = [], min(self.near, len(self.centres))
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            n = min(max(16, self.few), most)
            order = self.order(part, n)
            held = np.cumsum(self.sizes[order], axis=1)
            if n < most and (held[:, -1] < self.look).any():
                order = self.order(part, most)
                held = np.cumsum(self.sizes[order], axis=1)
            enough = np.maximum((held < self.look).sum(1) + 1, self.few)
            out += [np.sort(row[:e]).astype(np.int32) for row, e in zip(order, enough)]
        return out


def places(units: DataFrame, sample: np.ndarray, n: int, books: np.ndarray, matrix, look: int, few: int, near: int) -> Places:
    """Cells for n vectors of which `sample` are some or all."""
    cells = min(-(-n // CROWD), WORDS * WORDS)
    if len(sample) >= n:
        centres, held = fit_centres(sample, cells)
        return Places(books[0], np.zeros(len(centres), np.int64), centres, held, look, few, near)
    share = min(1.0, FIT * cells / n)
    first = books[0]
    # vectors of a first code are fitted apart, in as many parts as are needed
    parts = np.maximum(1, -(-np.bincount(nearest(sample, first), minlength=len(first)) * int(share * n) // (len(sample) * FITTED)))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = unit(matrix(batch["v"])).astype(np.float32)
                c1 = nearest(x, first)
                yield pd.DataFrame({"c1": c1, "part": salts(batch["id"]) % parts[c1], "vec": [row.tobytes() for row in x]})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # rows come in any order, and the same vectors must give the same centres
        x = np.frombuffer(b"".join(sorted(group["vec"])), np.float32).reshape(len(group), -1)
        centres, held = fit_centres(x, max(1, round(len(x) * cells / (share * n))))
        return pd.DataFrame({"c1": group["c1"].iloc[0], "n": held, "centre": [row.tobytes() for row in centres]})

    some = units.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    found = some.mapInPandas(part, "c1 int, part int, vec binary").groupBy("c1", "part").applyInPandas(fit, "c1 int, n int, centre binary").toPandas()
    found = found.sort_values(["c1", "centre"], kind="stable")
    centres = np.frombuffer(b"".join(found["centre"]), np.float32).reshape(len(found), -1)
    return Places(first, found["c1"].to_numpy(), centres, found["n"].to_numpy() / share, look, few, near)


def top_similar(df: DataFrame, id_col: str, vector: str, k: int = 10, size: int = 64, look: int = LOOK, few: int = CELLS, near: int = NEAR, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """For each usable vector the k others with the highest cosine: id, other, cosine, place (1 is the nearest).

    look, few, near: each vector is filed in the nearest cells until they hold `look` vectors and are at least `few`, at most
    `near`, and looks through them; rerank: so many candidates of each block of a cell are measured exactly. exact: one cell,
    and all candidates. Of equal cosines the smaller id comes first, however many vectors are equal. Fewer than two usable
    vectors give no rows. Other columns are not read. Indexing runs when this is called.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    units = scratch.write(usable_vectors(df, id_col, vector, size))
    kind, number = units.schema["id"].dataType.simpleString(), np.float32 if units.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    shape = f"id {kind}, other {kind}, cosine double"

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_list()).astype(number)

    def read(column: pd.Series) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column), number).reshape(len(column), -1))

    n = units.count()
    if n < 2:
        return spark.createDataFrame([], f"{shape}, place int")
    sample = unit(matrix(units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"])).astype(np.float32)
    fitted = fit_codebooks(sample)
    books = spark.sparkContext.broadcast(fitted)
    if exact:
        rerank = 1 << 62
        planned = Places(fitted[0], np.zeros(1, np.int64), np.zeros((1, size)), np.array([n]), n, 1, 1)
    else:
        planned = places(units, sample, n, fitted, matrix, look, few, near)
    known = spark.sparkContext.broadcast(planned)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch[at : at + 2048]
                given = matrix(part["v"])
                x = unit(given).astype(np.float32)
                codes, norms = encode(x, books.value)
                yield pd.DataFrame({"id": part["id"], "vec": [row.tobytes() for row in given], "codes": [c.tobytes() for c in codes], "norm": norms, "cells": known.value.looks(x)})

    indexed = scratch.write(units.mapInPandas(index, f"id {kind}, vec binary, codes binary, norm float, cells array<int>"))
    scratch.drop(units)
    counts = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # one row per cell at most
    held = np.zeros(len(planned.centres), np.int64)
    held[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    blocks, turns = np.maximum(1, -(-held // BLOCK)), np.maximum(1, -(-held // (4 * BLOCK)))
    alone = blocks > 1
    packs = np.where(alone, np.cumsum(alone) - 1, alone.sum() + np.cumsum(np.where(alone, 0, held)) // PACK)
    plan = spark.sparkContext.broadcast((blocks, turns, packs))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector once for each of its cells, where it is found and looks; if the cell is cut into blocks, once for every turn
        of lookers where it is found, and once for every block where it looks."""
        blocks, turns, packs = plan.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch[at : at + 1024]
                cell = np.concatenate(part["cells"].to_list())
                row = np.repeat(np.arange(len(part)), part["cells"].map(len))
                salt = salts(part["id"])[row]
                cut = blocks[cell] > 1
                found, looks = np.repeat(np.arange(len(cell)), turns[cell]), np.repeat(np.arange(len(cell)), np.where(cut, blocks[cell], 0))
                every = np.concatenate([found, looks])
                role = np.where(np.arange(len(every)) >= len(found), LOOKS, np.where(cut[every], FOUND, BOTH))
                rows = row[every]
                yield pd.DataFrame({
                    "pack": packs[cell[every]],
                    "block": np.concatenate([(salt % blocks[cell])[found], upto(np.where(cut, blocks[cell], 0))]),
                    "turn": np.concatenate([upto(turns[cell]), ((salt // 7919) % turns[cell])[looks]]),
                    "cell": cell[every],
                    "role": role,
                    "id": part["id"].to_numpy()[rows],
                    "vec": part["vec"].to_numpy()[rows],
                    "codes": np.where(role == LOOKS, None, part["codes"].to_numpy()[rows]),
                    "norm": part["norm"].to_numpy()[rows],
                    "cells": part["cells"].to_numpy()[rows],
                })

    def score(group: pd.DataFrame) -> pd.DataFrame:
        out = [part for _, some in group.groupby("cell", sort=False) for part in compared(some)]
        return pd.concat(out) if out else pd.DataFrame({"id": group["id"][:0], "other": group["id"][:0], "cosine": np.zeros(0)})

    def compared(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        here, role, b = int(cell["cell"].iloc[0]), cell["role"].to_numpy(), books.value
        ids, wide = cell["id"].to_numpy(), read(cell["vec"])
        x = wide.astype(np.float32)
        longest = max(map(len, cell["cells"]))
        cells = np.full((len(cell), longest), -1, np.int32)
        for at, c in enumerate(cell["cells"]):
            cells[at, : len(c)] = c
        owners, lookers = np.flatnonzero(role != LOOKS), np.flatnonzero(role != FOUND)
        # of equal vectors, no one has more than the first k + 1 among the nearest
        same = pd.factorize(cell["vec"].iloc[owners])[0]
        if len(owners) and np.bincount(same).max() > k + 1:
            order = np.lexsort((pd.factorize(ids[owners], sort=True)[0], same))
            owners = owners[order[upto(np.bincount(same)) <= k]]
        if not len(owners) or not len(lookers):
            return
        keep = min(rerank, len(owners))
        mine = pd.Index(ids[owners]).get_indexer(ids[lookers])
        y = x[owners]
        tables = keep < len(owners)
        if tables:
            codes = np.frombuffer(b"".join(cell["codes"].iloc[owners]), np.uint8).reshape(len(owners), -1)
            norms = np.maximum(cell["norm"].to_numpy()[owners], 1e-6)
        some = 64 if tables else 128  # what is held at a time stays in the caches
        for at in range(0, len(lookers), some):
            part, own = lookers[at : at + some], mine[at : at + some]
            q = x[part]
            if tables:
                # tables by word, so that adding up a stage copies whole rows of lookers
                guess = np.zeros((len(y), len(q)), np.float32)
                for m in range(codes.shape[1]):
                    guess += np.take(b[m] @ q.T, codes[:, m], axis=0)
                guess /= -norms[:, None]
                best = np.argpartition(np.ascontiguousarray(guess.T), keep - 1, axis=1)[:, :keep]
                near = np.matmul(y[best], q[:, :, None])[:, :, 0]
                near[best == own[:, None]] = -9
            else:
                near = q @ y.T
                near[np.flatnonzero(own >= 0), own[own >= 0]] = -9
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1] - SLACK if k < near.shape[1] else np.full(len(q), -8.0, np.float32)
            row, col = np.nonzero(near >= np.maximum(least, -8)[:, None])
            other = owners[best[row, col] if tables else col]
            # a pair that shares several cells comes out of the first
            shared = np.zeros(len(row), bool)
            for j in range(longest):
                mark = cells[part[row], j]
                shared |= (mark >= 0) & (mark < here) & (cells[other] == mark[:, None]).any(1)
            row, other = row[~shared], other[~shared]
            cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", wide[part[row[a : a + 65536]]], wide[other[a : a + 65536]]) for a in range(0, len(row), 65536))])
            if len(row) > 2 * k * len(q):
                order = np.lexsort((pd.factorize(ids[other], sort=True)[0], -cosine, row))
                order = order[upto(np.bincount(row, minlength=len(q))) < k]
                row, other, cosine = row[order], other[order], cosine[order]
            yield pd.DataFrame({"id": ids[part[row]], "other": ids[other], "cosine": cosine})

    filed = indexed.mapInPandas(file, f"pack int, block int, turn int, cell int, role int, id {kind}, vec binary, codes binary, norm float, cells array<int>")
    found = filed.groupBy("pack", "block", "turn").applyInPandas(score, shape)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
