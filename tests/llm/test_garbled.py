import pytest

from engram.llm.garbled import garbled_lines, items, undo

CLEAN = ["Für Lauf {} gilt: die Prüfsumme löscht die größten Schlüssel übrigens später", "D’après le rapport {}, l’équipe a vérifié les entrées périmées", "En la sesión {} añadió el límite según la configuración", "{}번 메모: 기억 저장소가 오래된 항목을 확인했습니다", "It’s likely that run {} hasn’t finished — see “notes”…"]
WRONG = {
    "utf8>1252": lambda s: s.encode().decode("cp1252", errors="strict") if _fits(s.encode(), "cp1252") else s.encode().decode("latin-1"),
    "utf8>mac": lambda s: s.encode().decode("mac_roman"),
    "utf8>437": lambda s: s.encode().decode("cp437"),
    "1252>mac": lambda s: s.encode("cp1252").decode("mac_roman"),
}
RIGHT = ["SÃO e IRMÃ são nomes de áreas no índice antigo.", "The importer showed `Ã©` where `é` was meant.", "Search the dump for the sign � before you sign off.", "Trần Ân: Âm thanh, Ân cần.", "Память очищена; журнал проверен ещё раз.", "∑ w ≈ √n · π, where ∞ marks no limit", "記憶の整理は完了しました。", "été and café use combining marks.", "", None, "plain ascii", "   "]


def _fits(raw, charset):
    try:
        raw.decode(charset)
        return True
    except UnicodeDecodeError:
        return False


def table(spark, texts):
    return spark.createDataFrame([(k, t, "notes", "x", 1) for k, t in enumerate(texts)], "id long, body string, src string, key string, line int")


def test_garbled_lines_are_found_and_restored(spark):
    clean = [c.format(k) for k in range(40) for c in CLEAN]
    bad, original = [], []
    for chain, spoil in WRONG.items():
        for k in range(6):
            for c in CLEAN if chain.startswith("utf8") else CLEAN[:3]:
                original.append(c.format(k))
                bad.append(spoil(original[-1]))
    lost = [c.format(k).encode("cp1252", "ignore").decode("utf-8", "replace") for k in range(5) for c in CLEAN[:3]]
    twice = [WRONG["utf8>1252"](WRONG["utf8>1252"](CLEAN[1].format(k))) for k in range(5)]
    texts = clean + RIGHT + bad + lost + twice + ["first line\n" + bad[0] + "\nlast line"] + bad[:3]
    got = {}
    for r in garbled_lines(table(spark, texts), "id", "src", ["body"]).collect():
        got[r.key] = r
    first_bad = len(clean) + len(RIGHT)
    assert set(got) == set(range(first_bad, len(texts)))
    restored = [got[first_bad + k].restored for k in range(len(bad))]
    assert sum(a == b for a, b in zip(restored, original)) >= 0.95 * len(bad)
    assert all(got[k].chain == "lost" and got[k].restored is None for k in range(first_bad + len(bad), first_bad + len(bad) + len(lost)))
    assert got[len(texts) - 4].nth == 1


def test_nothing_to_find(spark):
    assert garbled_lines(table(spark, []), "id", "src", ["body"]).collect() == []
    assert garbled_lines(table(spark, RIGHT), "id", None, ["body", "src"]).collect() == []


@pytest.mark.parametrize("text", ["größten", "한국어", "’ … “”"])
def test_undoing(text):
    assert undo(WRONG["utf8>1252"](text), "utf8>1252") == text
    assert undo(text, "utf8>1252") is None


def test_runs_know_where_they_stand():
    assert [t[0] for t in items("shows `Ã©` here")] == ["2"]
    assert [t[0] for t in items("cafÃ© here")] == ["0"]
    assert [t[0] for t in items("the sign � here, co�te")] == ["1", "0"]
    assert items("the sign � here")[0][1:5] == items("a Sign – b")[0][1:5] != items("a mark – b")[0][1:5]
    assert [t[6:-1] for t in items("said “cafÃ©” there")] == ["“", "Ã©", "”"]
    assert items("plain") == []


def test_lines_of_which_little_is_known(spark):
    """Garbled words among few clean lines, and quoted garbled words; cited characters are no case."""
    clean = [c.format(k) for k in range(40) for c in CLEAN]
    bad = ["Plan caf챕 noir", "Z체rich", "m챕moire vive 챕t챕", "gr철횩e M체ller", 'The note said "í•œêµ\xadì–´"', "The note said í•œêµ\xadì–´", "The note said “í•œêµ\xadì–´” twice"]
    cites = ["The importer showed `Ã©` where `é` was meant.", "Search the dump for the sign � before you sign off.", "Look for “â€™” in the log", "It showed 'Ã¼' again"] * 5
    got = {r.line for r in garbled_lines(table(spark, clean + bad + cites), "id", "src", ["body"]).collect()}
    assert got == set(bad)


def test_sources_beyond_those_held_by_tasks(spark, monkeypatch):
    """Shares joined to the lines give what shares in the tasks' hands give."""
    from engram.llm import garbled

    texts = [c.format(k) for k in range(30) for c in CLEAN] + [WRONG["1252>mac"](c.format(k)) for k in range(4) for c in CLEAN[:3]]
    df = table(spark, texts).selectExpr("id", "body", "IF(id % 3 = 0, NULL, concat('s', id % 5)) AS src")
    said = lambda: sorted((r.key, r.chain, r.restored, round(r.probability, 6)) for r in garbled_lines(df, "id", "src", ["body"]).collect())
    held = said()
    monkeypatch.setattr(garbled, "FEW_GROUPS", 2)
    assert said() == held and len(held) >= 10


def test_latin_read_as_hangul_is_found(spark):
    wrong = lambda s: s.encode().decode("cp949")
    said = ["Le café {} est prêt", "Der größten Liste {} aus Zürich", "Le déjà vu {} du café"]
    clean = [c.format(k) for k in range(40) for c in (*CLEAN, *said)] + ["찾은 항목은 차 한 대", "후 처 차 철", "한국어 찾"] * 5
    bad = [c.format(k) for k in range(5) for c in said]
    got = {r.key: r for r in garbled_lines(table(spark, clean + [wrong(c) for c in bad]), "id", "src", ["body"]).collect()}
    assert set(got) == set(range(len(clean), len(clean) + len(bad)))
    assert [got[len(clean) + k].restored for k in range(len(bad))] == bad


def test_long_lines_garbled_in_part_are_found(spark):
    clean = [c.format(k) for k in range(40) for c in CLEAN]
    right = [" ".join(CLEAN[(n + k) % 3].format(k) for n in range(12)) for k in range(6)]
    part = [(" ".join(CLEAN[(n + k) % 3].format(k) for n in range(6)), CLEAN[k % 3].format(k)) for k in range(6)]
    bad = [f"{a} {WRONG['utf8>1252'](b)} {a}" for a, b in part]
    lost = [a + " " + b.encode("cp1252", "ignore").decode("utf-8", "replace") for a, b in part]
    texts = clean + right + bad + lost
    got = {r.key: r for r in garbled_lines(table(spark, texts), "id", "src", ["body"]).collect()}
    first = len(clean) + len(right)
    assert set(got) == set(range(first, len(texts)))
    assert [got[first + k].restored for k in range(len(bad))] == [f"{a} {b} {a}" for a, b in part]
    assert all(got[first + len(bad) + k].restored is None for k in range(len(lost)))
