import random

import pytest

from engram.llm.tokens import VOCABULARY, Encoded, Vocabulary, token_ids

TEXTS = ["", "Hello  world's end\n\n\t<|endoftext|> 12345", "été 한국어 시험 😀👩‍💻", "a" * 300, " " * 50, "don't I'LL we've", "x\u0000y\r\n", "​﻿", "naïve café — “quote”…"]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_public_encoder(public):
    v, rng = Vocabulary.load(), random.Random(5)
    noise = ["".join(rng.choice("aaabcd eethnrs 0123'\n\t  éü한글😀<|>") for _ in range(rng.randint(1, 150))) for _ in range(500)]
    for text in TEXTS + noise:
        assert v.encode(text) == public(text), text


def test_prefix_table_can_be_carried_on():
    v = Vocabulary.load()
    word = b" internationalization"
    whole = v.extend(word, [])
    for cut in range(len(word)):
        assert v.extend(word, v.extend(word[:cut], [])) == whole
        assert v.read(whole[:cut]) == v.read(v.extend(word[:cut], []))


def test_edits_and_appends_are_exact_and_local():
    v, rng = Vocabulary.load(), random.Random(6)
    text = "The nightly export hasn't copied 4321 notes; don't ask why.  " * 40
    e = Encoded(v, text)
    for _ in range(150):
        i = rng.randint(0, len(text))
        j = min(len(text), i + rng.randint(0, 12))
        new = "".join(rng.choice("ab c'd \n12é") for _ in range(rng.randint(0, 6)))
        anew = e.replace(i, j, new)
        text = text[:i] + new + text[j:]
        assert e.text == text and e.ids == v.encode(text) and anew < 40
    e.append("'ll go  on")
    assert e.ids == v.encode(text + "'ll go  on")
    assert Encoded(v).ids == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello", "x"), (4, "word " * 40000, "x")], "key int, t string, ids string")
    got = [(r.key, list(r.ids)) for r in token_ids(df, "key", "t").collect()]
    assert sorted(got)[:2] == [(1, [15496]), (1, [15496])] and (2, []) in got and (3, []) in got and len(dict(got)[4]) == 40001
    assert token_ids(df.limit(0), "key", "t").collect() == []
