import random

import numpy as np
import pytest

from engram.llm import pii, pii_invented
from engram.llm.pii import N_TAGS, OVERLAP, WINDOW, Tagger, masked, mentions, owned, to_spans, windows
from engram.llm.pii_training import Trainer, label, measure, tags_of, unseen
from pyspark.sql import functions as F

TEXT = "Please call +33 1 99 00 89 55 or write to soren+tas@example.net. Signed off by Greta Aldyorquay and I. Halmarinski. Part no. 901-15-4524 of the disk tray is out of stock. Die Kennung 905 43 9510 gehört zu Jürgen Cambarquay. The letter went to Flat 3, 118 Tovcam Blvd, Ostermouth last week. Pull from git@code1.test:memory/core.git before run 936."


def test_mentions_and_masks(spark):
    rows = [("a", TEXT), ("a", TEXT), ("b", None), ("c", ""), ("d", "   "), ("e", "nothing here"), (None, TEXT), ("long", (TEXT + " ") * 300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, content string, kind string, nth int")
    got = {(r.id, r.kind, r.nth) for r in mentions(df, "id", "content").collect()}
    want = {("phone", 1), ("email", 1), ("name", 1), ("name", 2), ("name", 3), ("id_number", 1), ("address", 1)}
    assert {(k, n) for i, k, n in got if i == "a"} == want == {(k, n) for i, k, n in got if i is None}
    assert {i for i, *_ in got} == {"a", None, "long"}
    assert {(k, n) for i, k, n in got if i == "long"} == {(k, n) for k, m in (("phone", 300), ("email", 300), ("name", 900), ("id_number", 300), ("address", 300)) for n in range(1, m + 1)}
    text = {r.id: r.m for r in df.filter("id IS NOT NULL").select("id", masked(F.col("content")).alias("m")).collect()}
    assert text["a"].startswith("Please call [PHONE] or write to [EMAIL]. Signed off by [NAME] and [NAME]. Part no. 901-15-4524 of") and text["b"] is None and text["c"] == "" and text["e"] == "nothing here"
    assert mentions(df.limit(0), "id", "content").collect() == []


def test_windows_cover_with_overlap():
    for n in (1, WINDOW, WINDOW + 1, 300, 1000, 4321):
        cut = windows(n)
        assert cut[0][0] == 0 and cut[-1][1] == n and all(b - a <= WINDOW for a, b in cut)
        assert all(b - c >= OVERLAP for (_, b), (c, _) in zip(cut, cut[1:]))
        own = owned(cut)
        assert own[0][0] == 0 and own[-1][1] == n and all(b == c for (_, b), (c, _) in zip(own, own[1:]))
        assert all(a <= lo < hi <= b for (a, b), (lo, hi) in zip(cut, own))
    assert windows(0) == [] == owned([])


def test_every_character_is_scored(monkeypatch):
    """All characters of all texts reach the network, whatever they are."""
    texts = ["nothing here", "공백 없는 글", "x" * 3000, "Ж", "plain words only " * 400]
    own, given = [], Tagger.scores
    monkeypatch.setattr(Tagger, "scores", lambda self, seqs: own.append(sum(map(len, seqs))) or given(self, seqs))
    e = Tagger.load().emissions(texts)
    assert len(e) == sum(map(len, texts)) <= sum(own) and np.isfinite(e).all()


def tagger(rng):
    w = {"wx": np.zeros((2, 3, 4)), "wh": np.zeros((2, 1, 4)), "out": np.zeros((2, N_TAGS)), "bias": np.zeros(N_TAGS), "trans": rng.normal(size=(N_TAGS, N_TAGS)), "start": rng.normal(size=N_TAGS)}
    return Tagger(w)


def best_path(t, e, begins=True, ends=True):
    best, score = None, -1e9
    trans, start = t.w["trans"], t.w["start"] if begins else t.w["trans"][0]
    for path in np.ndindex(*(N_TAGS,) * len(e)):
        s = start[path[0]] + sum(e[k, p] for k, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])) + (0 if ends else trans[path[-1], 0])
        if s > score:
            best, score = path, s
    return best


def test_stretches_are_decided_by_the_best_path():
    rng = np.random.default_rng(1)
    t = tagger(rng)
    for n in (1, 2, 3, 4):
        for begins, ends in ((True, True), (False, True), (True, False), (False, False)):
            e = rng.normal(size=(n, N_TAGS)).astype(np.float32)
            got = t.decide(e, np.array([[0, n, begins, ends]])).get(0, np.zeros(n, np.int8))
            assert tuple(got) == best_path(t, e, begins, ends)


def test_what_is_surely_outside_is_outside_in_the_best_path():
    rng = np.random.default_rng(2)
    some = 0
    for _ in range(150):
        t = tagger(rng)
        e = rng.normal(size=(4, N_TAGS)).astype(np.float32) * 2
        e[:, 0] += rng.choice([0, 3, 9, 20], 4)
        sure = t.sure(e)
        some += sure.sum()
        assert not np.array(best_path(t, e))[sure].any()
    assert some > 50


def test_gradients_of_training():
    rng = np.random.default_rng(3)
    trainer = Trainer()
    e = rng.normal(size=(4, 2, N_TAGS)).astype(np.float64)
    y, lengths = rng.integers(0, N_TAGS, (4, 2)), np.array([4, 3])
    mask = (np.arange(4)[:, None] < lengths).astype(float)
    y = (y * mask).astype(int)
    loss, de, dtrans, _ = trainer.crf(e, y, mask, lengths)
    for t, r, k in ((0, 0, 3), (2, 1, 5), (3, 0, 0)):
        up = e.copy()
        up[t, r, k] += 1e-4
        assert (trainer.crf(up, y, mask, lengths)[0] - loss) / 1e-4 == pytest.approx(de[t, r, k], abs=2e-2)
    before = trainer.w["trans"].copy()
    trainer.w["trans"][1, 2] += 1e-2
    assert (trainer.crf(e, y, mask, lengths)[0] - loss) / 1e-2 == pytest.approx(dtrans[1, 2], abs=5e-2)
    trainer.w["trans"] = before


def test_training_learns():
    rng = random.Random(0)
    data = []
    for _ in range(200):
        pre, digits = "".join(rng.choice("abc ") for _ in range(rng.randint(3, 9))), "".join(rng.choice("0123456789") for _ in range(9))
        text = f"{pre} {digits} end"
        from engram.llm.pii import encode

        data.append((encode(text), tags_of(len(text), [(len(pre) + 1, len(pre) + 10, "phone")])))
    trainer = Trainer()
    losses = [trainer.step(data[k % 150 : k % 150 + 50], 0.01) for k in range(60)]
    assert losses[-1] < 0.2 * losses[0]


def test_the_weights_agree_with_the_labels():
    """A guard against broken weights, not a measure: these contents are among those trained on. README.md has unseen ones."""
    ds = pytest.importorskip("pyarrow.dataset")
    try:
        texts = [t for t in ds.dataset("/root/testdata/sf0.01/chunks.parquet").to_table(["content"])["content"].to_pylist() if t]
    except FileNotFoundError:
        pytest.skip("no test tables here")
    wrong = 0
    for text, found in zip(texts, Tagger.load().spans(texts), strict=True):
        wrong += sorted(k for *_, k in label(text)) != sorted(k for *_, k in found)
    assert wrong <= 0.005 * len(texts)


def test_spans():
    tags = np.array([0, 1, 2, 2, 1, 0, 3, 4])
    assert to_spans(tags, 10) == [(11, 14, "email"), (14, 15, "email"), (16, 18, "phone")]


def test_mentions_wherever_windows_and_groups_of_texts_end(monkeypatch):
    """The same mentions whatever the offset, in one text of many windows."""
    unit = "Please call +33 1 99 00 89 55 or write. "
    filler = "the plan is ready and the index is as it was before the run, "
    texts = [(filler * 2)[-pad - 1 :] + unit * 40 for pad in range(71)]
    monkeypatch.setattr(pii, "HELD", 5000)
    for text, found in zip(texts, Tagger.load().spans(texts), strict=True):
        assert [s[2] for s in found] == ["phone"] * 40 and {text[a:b] for a, b, _ in found} == {"+33 1 99 00 89 55"}


@pytest.mark.parametrize(
    ("text", "kind", "mention"),
    [("John Smith wrote the report.", "name", "John Smith"), ("We met Barack Obama and left.", "name", "Barack Obama"), ("Angela Merkel spoke first.", "name", "Angela Merkel"), ("Please ask Emmanuel Macron about it.", "name", "Emmanuel Macron"), ("Tim Cook signed the contract.", "name", "Tim Cook"), ("My social security number is 123-45-6789.", "id_number", "123-45-6789"), ("write to soren at example.net please", "email", "soren at example.net"), ("write to soren {at} example.net please", "email", "soren {at} example.net"), ("Łukasz Żak signed it.", "name", "Łukasz Żak"), ("담당자는 김민수입니다.", "name", "김민수"), ("Автор: Иван Петров", "name", "Иван Петров")],
)
def test_what_the_tables_never_say(text, kind, mention):
    assert (kind, mention) in [(k, text[a:b]) for a, b, k in Tagger.load().spans([text])[0]]


def test_templates_that_training_left_out():
    got = measure(Tagger.load(), unseen(600, ["The plan is ready."], seed=7))
    assert all(min(got[k]) > least for k, least in (("email", 0.95), ("name", 0.85), ("address", 0.9), ("phone", 0.7), ("id_number", 0.55)))
    known, held = pii_invented.templates(False), pii_invented.templates(True)
    assert not set(known[0]) & set(held[0]) and not set(known[1]) & set(held[1])


def test_scores_are_those_of_the_plain_network():
    rng = np.random.default_rng(9)
    with np.load(pii.__file__.replace("pii.py", "pii_weights.npz")) as f:
        w = {k: f[k].astype(np.float64) for k in f.files}
    size = w["wh"].shape[1]
    seqs = [rng.integers(0, pii.N_CLASSES, n) for n in (3, 40, 40, 17)]
    got = pii.Tagger.load().scores(seqs)
    for row, seq in enumerate(seqs):
        want = np.tile(w["bias"], (len(seq), 1))
        for way in (0, 1):
            h, c = np.zeros(size), np.zeros(size)
            for t in range(len(seq))[:: -1 if way else 1]:
                z = (w["wx"].reshape(2, -1, 4 * size)[way, seq[t]] + h @ w["wh"].reshape(2, size, 4 * size)[way]).reshape(4, size)
                into, keep, give = np.clip(z[:3] / 4 + 0.5, 0, 1)
                c = keep * c + into * z[3] / (1 + np.abs(z[3]))
                h = give * c / (1 + np.abs(c))
                want[t] += h @ w["out"].reshape(2, size, -1)[way]
        assert np.abs(got[: len(seq), row] - want).max() < 1e-3
