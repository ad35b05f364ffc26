from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from engram.functions.instants import add_utc_micros

SCHEMA = "text string, tz string, o string, _t string, _row int"


def us(*parts):
    return int((datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def found(spark, rows):
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows], SCHEMA)
    out = add_utc_micros(df, "text", "tz", "o").collect()
    assert all(r["_t"] == "kept" and r["_row"] == 7 for r in out)
    return {r.text: r.utc_us for r in out}


CASES = [
    ("2024-05-31T10:22:28.5123529+00:00[UTC]", None, None, us(2024, 5, 31, 10, 22, 28, 512352)),
    ("2024-07-21 22:06:12.363 +09:00", "UTC", None, us(2024, 7, 21, 13, 6, 12, 363000)),
    ("2025-02-25T19:37", "Asia/Seoul", None, us(2025, 2, 25, 10, 37)),
    ("2025-11-24/16-26-47", "America/New_York", None, us(2025, 11, 24, 21, 26, 47)),
    ("20250424T085723Z", None, None, us(2025, 4, 24, 8, 57, 23)),
    ("20251004143732", "UTC", None, us(2025, 10, 4, 14, 37, 32)),
    ("Tue, 22 Dec 2026 08:37:58 +0000", None, None, us(2026, 12, 22, 8, 37, 58)),
    ("Mon, 22 Dec 2026 08:37:58 +0000", None, None, None),
    ("27 Apr 2026 10:56:08", "Europe/Berlin", None, us(2026, 4, 27, 8, 56, 8)),
    ("Jun 28, 2026 12:15:09 AM KST", None, None, us(2026, 6, 27, 15, 15, 9)),
    ("7. Mai 2026, 09:25 Uhr", "Europe/Berlin", None, us(2026, 5, 7, 7, 25)),
    ("12. März 2025, 14:29 Uhr", "Europe/Berlin", None, us(2025, 3, 12, 13, 29)),
    ("2024년 11월 26일 오후 12시 32분 59초", "Asia/Seoul", None, us(2024, 11, 26, 3, 32, 59)),
    ("03/04/2025 01:02:03 PM", "UTC", "DMY", us(2025, 4, 3, 13, 2, 3)),
    ("03/04/2025 01:02:03 AM", "UTC", "MDY", us(2025, 3, 4, 1, 2, 3)),
    ("03/04/2025 01:02:03", "UTC", "YMD", None),
    ("1793890833601805", None, None, 1793890833601805),
    ("1793890833601805999", None, None, 1793890833601805),
    ("1793890833601", None, None, 1793890833601000),
    ("1793890833.6", None, None, 1793890833600000),
    ("1793890833", None, None, 1793890833000000),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, None),
    ("2024-03-31 02:30:00", "Europe/Berlin", None, None),
    ("2024-10-27 02:30:00 CEST", "Europe/Berlin", None, us(2024, 10, 27, 0, 30)),
    ("2024-04-07 01:45:00", "Australia/Lord_Howe", None, None),
    ("2024-10-27 03:00:00", "Europe/Berlin", None, us(2024, 10, 27, 2, 0)),
    ("2024-10-27 02:30:00 Asia/Seoul", "Europe/Berlin", None, us(2024, 10, 26, 17, 30)),
    ("2024-10-27 02:30:01[Asia/Seoul]", "Europe/Berlin", None, us(2024, 10, 26, 17, 30, 1)),
    ("2024-10-27 02:30:00 Nowhere/City", "Europe/Berlin", None, None),
    ("2025-02-30 11:20:00", "UTC", None, None),
    ("2024-13-01T00:00:00Z", None, None, None),
    ("2024-01-01T24:00:00Z", None, None, None),
    ("2024-01-01 10:00:00", None, None, None),
    ("  2024-02-29T23:59:59Z ", None, None, us(2024, 2, 29, 23, 59, 59)),
    ("", "UTC", "YMD", None),
    (None, "UTC", "YMD", None),
    ("pending", "UTC", "YMD", None),
    ("9" * 5000, "UTC", "YMD", None),
    ("2024-05-05 10:00:00." + "123456789" * 20 + "Z", None, None, us(2024, 5, 5, 10) + 123456),
    ("1793890833." + "6" * 200, None, None, 1793890833666666),
    ("1850-06-01 00:00:00Z", None, None, us(1850, 6, 1)),
    ("2500-06-01T00:00:00+01:00", None, None, us(2500, 5, 31, 23)),
    ("2024-05-05 10:00:00 Etc/GMT+5", None, None, us(2024, 5, 5, 15)),
    ("2024-05-05 10:00:00[Etc/GMT-14]", "UTC", None, us(2024, 5, 4, 20)),
    ("2024-05-05 10:00:00" + " " * 200, "UTC", None, us(2024, 5, 5, 10)),
]


def test_cases(spark):
    got = found(spark, [c[:3] for c in CASES])
    assert {text: got[text] for text, *_ in CASES} == {text: want for text, _, _, want in CASES}


def test_empty_table(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_every_half_hour_around_the_changes_against_brute_force(spark, zone):
    z = ZoneInfo(zone)
    first = datetime(2025, 1, 1)
    walls = [first + timedelta(minutes=30 * k) for k in range(48 * 365)]
    walls = [w for w in walls if w.month in (3, 4, 10, 11)]
    got = found(spark, [(w.strftime("%Y-%m-%d %H:%M:%S"), zone, None) for w in walls])
    for w in walls:
        instants = {w.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = [i for i in instants if i.astimezone(z).replace(tzinfo=None) == w]
        want = int((real[0] - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) if len(real) == 1 else None
        assert got[w.strftime("%Y-%m-%d %H:%M:%S")] == want, w
