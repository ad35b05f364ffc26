import pytest

from engram.llm.mixing import mixture, rate


def made(spark, records, targets, total=None, **more):
    r = spark.createDataFrame([(*x, "k", 1) for x in records], "id long, src string, n int, key string, u int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mixture(r, "id", "src", "n", t, total, **more)
    return [(x.id, x.source, x.copies) for x in mixed.collect()], {x.source: x for x in report.collect()}


RECORDS = [(k, "big", 50 + k % 100) for k in range(2000)] + [(5000 + k, "small", 40 + k % 20) for k in range(100)] + [(9000, "big", 30_000)]


def test_shares_and_caps(spark):
    mixed, report = made(spark, RECORDS + [(1, None, 5), (2, "other", 5), (3, "big", 0), (4, "big", None)], [("big", 0.7, 2), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.5, 1), ("small", 0.2, 3)])
    assert report["small"].reached_share == pytest.approx(0.2 / 0.9, abs=0.003) and report["big"].reached_share == pytest.approx(0.7 / 0.9, abs=0.003)
    assert report["absent"].records == 0 and report["absent"].reached_share == 0
    assert all(c == 3 for _, s, c in mixed if s == "small") and max(c for _, s, c in mixed if s == "big") <= 2
    assert len(mixed) == len({i for i, *_ in mixed})


def test_a_given_total_and_repeatability(spark):
    mixed, report = made(spark, RECORDS, [("big", 0.9, 2), ("small", 0.1, 3)], total=30_000)
    assert sum(report[s].used for s in report) == pytest.approx(30_000, abs=300)
    assert sorted(mixed) == sorted(made(spark, RECORDS[::-1], [("big", 0.9, 2), ("small", 0.1, 3)], total=30_000)[0])


def test_more_than_all_copies_gives_all_copies(spark):
    mixed, report = made(spark, RECORDS, [("big", 0.5, 2), ("small", 0.5, 2)], total=10**9)
    assert all(c == 2 for *_, c in mixed) and report["small"].used == 2 * report["small"].available


def test_empty(spark):
    assert made(spark, [], [("big", 1.0, 2)])[0] == [] and made(spark, RECORDS, [])[0] == []
    assert made(spark, RECORDS, [("absent", 1.0, None)])[1]["absent"].used == 0


def test_rates():
    assert rate([(1.0, 100)], 3, 150) == 1.5
    c = rate([(1.0, 100), (0.5, 100)], 2, 250)
    assert min(2, c) * 100 + min(2, c * 0.5) * 100 == pytest.approx(250)


def test_as_large_as_targets_allow(spark):
    report = made(spark, [(k, "a", 1) for k in range(100)] + [(200 + k, "b", 1) for k in range(10)], [("a", 0.5, 1), ("b", 0.5, 2)])[1]
    assert report["a"].wanted == 20 == report["a"].used and report["b"].used == 20


def test_long_records_less_often_only_if_asked(spark):
    records = [(k, "big", 10) for k in range(3000)] + [(10_000 + k, "big", 400) for k in range(60)]
    share = lambda mixed: sum(i >= 10_000 for i, *_ in mixed) / 60
    plain, halved = (made(spark, records, [("big", 1.0, 1)], total=27_000, **more)[0] for more in ({}, {"halve_above": 2.0}))
    assert 0.3 < share(plain) < 0.7 and share(halved) < 0.25


def test_more_sources_than_a_driver_likes(spark):
    records = [(k, f"s{k % 600}", 10 + k % 7) for k in range(6000)]
    mixed, report = made(spark, records, [(f"s{k}", 1.0 + k % 2, 2) for k in range(600)], total=40_000)
    assert len(report) == 600 and sum(r.used for r in report.values()) == pytest.approx(40_000, rel=0.05)
    assert all(abs(r.used - r.wanted) <= 16 for r in report.values())
