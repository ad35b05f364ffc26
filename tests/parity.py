"""Comparison of a query with its SQL on the smallest test tables."""

import math
from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows(names, records):
    return sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in records)


def same(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, str(FOLDER))
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())
