"""Comparison of a query with its SQL in DuckDB, as the driver makes it."""

import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def both(spark, folder, name, entry):
    d = entry.queries()[name](spark, folder)
    cols = sorted(d.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in d.collect()), key=key)
    r = connect(folder).execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=key)
    assert [names[i] for i in order] == cols
    return mine, theirs
