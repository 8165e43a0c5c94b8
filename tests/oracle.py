"""Comparing a query with its SQL on the supplied tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def same(spark, query, sql: str, sf: str = SF) -> None:
    got = query(spark, sf)
    found = connect(sf).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted(([plain(v) for v in r] for r in found.fetchall()), key=key)
    have = sorted(([plain(r[n]) for n in names] for r in got.collect()), key=key)
    assert len(have) == len(want)
    assert have == want
