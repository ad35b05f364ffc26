import numpy as np
import pytest

from engram.llm import neighbours
from engram.llm.neighbours import encode, fit_codebooks, top_similar, upto


def exact(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(i, ids[j]) for i, row in zip(ids, s) for j in np.argsort(-row)[:k]}


def found(spark, rows, k=10, size=8):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, v array<float>, cell string, norm int")
    return df, {(r.id, r.other): r.place for r in top_similar(df, "id", "v", k, size).collect()}


def test_recall_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    vectors = {f"v{k:04d}": (centres[k % 20] + 0.3 * rng.normal(size=8)) * rng.uniform(0.01, 50) for k in range(1200)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    rows += rows[:30]  # repeated rows count once
    rows += [("null", None), ("short", [1.0] * 7), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("inf", [float("inf")] + [1.0] * 7), ("hole", [None] + [1.0] * 7), (None, [1.0] * 8)]
    _, got = found(spark, rows)
    want = exact(vectors, 10)
    assert len(want & set(got)) / len(want) > 0.97
    assert all(1 <= p <= 10 for p in got.values()) and len(got) == 12000
    assert not {"null", "short", "zero", "nan", "inf", "hole", None} & {i for pair in got for i in pair}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rows = [(f"v{k}", [float(k + 1), 1.0] + [0.0] * 6) for k in range(n)]
    assert len(found(spark, rows)[1]) == n * (n - 1)


def crowd():
    rng = np.random.default_rng(4)
    vectors = {f"v{k:05d}": (np.ones(8) + 1e-3 * rng.normal(size=8) if k % 3 == 0 else rng.normal(size=8)) for k in range(1500)}
    return [(i, [float(x) for x in v]) for i, v in vectors.items()]


def test_a_third_of_all_vectors_nearly_the_same(spark):
    _, got = found(spark, crowd())
    assert len(got) == 15000
    assert all(int(b[1:]) % 3 == 0 for a, b in got if int(a[1:]) % 3 == 0)


def test_crowded_cells_are_divided_and_cut_into_blocks(spark, monkeypatch):
    whole = set(found(spark, crowd())[1])
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # read where cells are planned
    cut = set(found(spark, crowd())[1])
    assert len(cut) == 15000 and len(cut & whole) >= 0.999 * len(whole)
    monkeypatch.setattr(neighbours, "CROWD", 20)
    divided = set(found(spark, crowd())[1])
    assert len(divided) == 15000 and len(divided & whole) >= 0.9 * len(whole)


def test_spreading():
    assert upto(np.array([3, 0, 2])).tolist() == [0, 1, 2, 0, 1] and upto(np.array([], int)).tolist() == []


def test_encoding_by_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    books = fit_codebooks(x, stages=4, words=32)
    errors = []
    for beam in (1, 8):
        codes, norms = encode(x, books, beam)
        made = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose(np.linalg.norm(made, axis=1), norms, atol=1e-3)
        errors.append(float(((x - made) ** 2).sum()))
    assert errors[1] < errors[0] < float((x**2).sum()) and neighbours.BEAM > 1


def test_the_exact_way_is_exact(spark):
    rng = np.random.default_rng(8)
    vectors = {f"v{k:04d}": rng.normal(size=8) for k in range(700)}  # no groups: the hardest case for cells
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id string, v array<float>")
    got = {(r.id, r.other) for r in top_similar(df, "id", "v", 10, 8, exact=True).collect()}
    assert got == exact(vectors, 10)
    less = {(r.id, r.other) for r in top_similar(df, "id", "v", 10, 8, look=50, few=1, rerank=20).collect()}
    assert len(less & got) < len(got)


def test_recall_where_cells_are_many(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CROWD", 16)  # as many cells for each vector as in a collection of millions
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(670, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = {f"v{k:04d}": centres[k % 670] + 0.35 * rng.normal(size=64) / 8 for k in range(8040)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id string, v array<float>")
    got = {(r.id, r.other) for r in top_similar(df, "id", "v", 10, 64, look=16, few=5).collect()}
    want = exact(vectors, 10)
    assert len(want & got) / len(want) > 0.995


def test_of_many_equal_vectors_the_smallest_ids_come_out(spark):
    rng = np.random.default_rng(6)
    rows = [(f"v{k:04d}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for k in rng.permutation(1400)]
    rows += [(f"w{k:04d}", [float(x) for x in rng.normal(size=8)]) for k in range(200)]
    _, got = found(spark, rows, k=3)
    for i, want in (("v0000", ["v0001", "v0002", "v0003"]), ("v0002", ["v0000", "v0001", "v0003"]), ("v1399", ["v0000", "v0001", "v0002"])):
        assert [got[i, other] for other in want] == [1, 2, 3]


def test_first_codes_that_are_fitted_apart(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    monkeypatch.setattr(neighbours, "FITTED", 500)
    monkeypatch.setattr(neighbours.Places, "FLAT", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(150, 8))
    vectors = {f"v{k:04d}": centres[k % 150] + 0.1 * rng.normal(size=8) for k in range(3000)}
    _, got = found(spark, [(i, [float(x) for x in v]) for i, v in vectors.items()])
    want = exact(vectors, 10)
    assert len(want & set(got)) / len(want) > 0.995
