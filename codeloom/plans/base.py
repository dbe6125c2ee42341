"""Registration of queries with their SQL, and SQL for the current graph."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def latest_sql(table: str, at: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {at} DESC) AS rn FROM {table}) WHERE rn = 1"


#: f, s, e: current files, live symbols (with the SDK's) and current edges.
GRAPH = f"""WITH RECURSIVE f AS ({latest_sql("files", "indexed_at")}),
s AS (SELECT * FROM ({latest_sql("symbols", "indexed_at")}) WHERE removed_at IS NULL UNION ALL SELECT * FROM ({latest_sql("sdk_symbols", "indexed_at")}) WHERE removed_at IS NULL),
e AS ({latest_sql("edges", "indexed_at")})
"""
