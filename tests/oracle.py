"""Compare a query with its SQL on the same tables."""

import glob
import os

import duckdb

SF = os.environ.get("CORVANE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = sorted(os.path.basename(p).removesuffix(".parquet") for p in glob.glob(f"{SF}/*.parquet"))


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 8) + 0.0)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def assert_same(df, sql):
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.toArrow().to_pylist())
    got = connect().execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall())
    assert mine == theirs
