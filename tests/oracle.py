"""Compare a query with its SQL on the same parquet tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def check(spark, query, sql):
    df = query(spark, str(DATA))
    have = [r.asDict(True) for r in df.collect()]
    if sql is None:
        return
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    rows = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in have]
    assert sorted(mine, key=str) == sorted(rows, key=str)
