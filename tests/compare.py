"""A registered query against its DuckDB twin on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def assert_same(spark, con, name, function, sql, sf_dir):
    got = function(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns), (name, got.columns, want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b), f"{name}: {len(a)} rows, {len(b)} in SQL"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not close(x, y)]
    assert not bad, f"{name}: {len(bad)} rows differ, first {bad[0]}"
    return len(a)


def close(x, y):
    return all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and not isinstance(p, bool) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y, strict=True))
