import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeloom.operators import orphans as O
from codeloom.runtime import work_area

T = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def tables(spark, edges, calls=(), symbols=(), sdk=(), files=(), runs=()):
    mk = spark.createDataFrame
    return (
        mk(list(edges), "id string, src_id string, dst_id string, indexed_at timestamp, reason string"),
        mk(list(calls), "id string, run_id string, called_at timestamp, logged_at timestamp"),
        mk(list(symbols), "id string, indexed_at timestamp, removed_at timestamp, space int"),
        mk(list(sdk), "id string, indexed_at timestamp, removed_at timestamp"),
        mk(list(files), "id string, indexed_at timestamp"),
        mk(list(runs), "id string, created_at timestamp, status string"),
    )


def test_reasons(spark, rows):
    t = tables(
        spark,
        edges=[
            ("e1", "sym:a", "sym:none", T[5], "x"), ("e2", "sym:a", "sym:gone", T[5], "x"), ("e3", "file:f", "sym:new", T[5], "x"), ("e4", "mod:m", "symref:z", T[5], "x"),
            ("e5", "file:none", "sym:sdk", T[35], "x"), ("e6", None, "", T[5], "x"), ("e7", "sym:a", "sym:a", T[9], "x"), ("e7", "sym:a", "sym:none", T[5], "x"), (None, "sym:none", "sym:none", T[5], "x"),
            ("e8", "sym:a", "sym:new", None, "x"), ("e9", "sym:back", "sym:A", T[5], "x"),
        ],
        calls=[("c1", "run-1", T[1], T[1]), ("c2", None, T[1], T[1]), ("c3", "", T[1], T[1]), ("c4", "run-x", T[33], T[34]), ("c5", "run-d", T[1], T[1]), ("c1", "run-x", T[1], T[0])],
        symbols=[("sym:a", T[1], None, 1), ("sym:gone", T[1], T[2], 1), ("sym:new", T[7], None, 1), ("sym:back", T[1], T[2], 1), ("sym:back", T[3], None, 1), (None, T[1], None, 1)],
        sdk=[("sym:sdk", T[1], None)], files=[("file:f", T[1]), ("file:f", T[8])], runs=[("run-1", T[3], "complete"), ("run-d", T[0], "deleted"), ("run-d", T[0], "deleted")],
    )
    assert rows(O.code_orphans(*t)) == [
        ("ch_tool_calls", "run_id", "c1", "late", "2020-01"), ("ch_tool_calls", "run_id", "c4", "missing", "2020-02"), ("ch_tool_calls", "run_id", "c5", "deleted", "2020-01"),
        ("edges", "dst_id", "e1", "missing", "2020-01"), ("edges", "dst_id", "e2", "deleted", "2020-01"), ("edges", "dst_id", "e3", "late", "2020-01"), ("edges", "dst_id", "e9", "missing", "2020-01"),
        ("edges", "src_id", "e5", "missing", "2020-02"),
    ]
    assert sum(r["n_refs"] for r in O.orphan_report(O.code_orphans(*t)).collect()) == 8


def test_empty_tables(spark):
    assert O.code_orphans(*tables(spark, [])).count() == 0
    t = tables(spark, [("e1", "sym:a", "sym:a", T[5], "x")])
    assert {(r["ref_field"], r["reason"]) for r in O.code_orphans(*t).collect()} == {("src_id", "missing"), ("dst_id", "missing")}


@pytest.mark.parametrize("hot_ranges", [0, 1_000_000])
def test_many_ranges_and_hot_target_equal_brute_force(spark, monkeypatch, hot_ranges):
    monkeypatch.setattr(O, "HOT_RANGES", hot_ranges)
    monkeypatch.setattr(O, "PARENTS_A_RANGE", 100)
    monkeypatch.setattr(O, "REFS_A_SHARD", 200)
    parents = spark.range(1000).select(F.lit(1).alias("space"), F.concat(F.lit("p"), F.col("id") * 2).alias("id"), F.timestamp_micros(F.col("id")).alias("first"), (F.col("id") % 10 == 0).alias("gone"))
    refs = spark.range(5000).select(F.lit(1).alias("ref_kind"), F.col("id").cast("string").alias("row_id"), F.lit(1).alias("space"), F.when(F.col("id") % 3 == 0, "p40").otherwise(F.concat(F.lit("p"), F.col("id") % 2500)).alias("id"), F.timestamp_micros(F.lit(500)).alias("ref_at"))
    got = {r["row_id"]: r["reason"] for r in O.orphans(parents, refs, work_area(spark, "t"), 1000).collect()}
    want = {}
    for i in range(5000):
        k = 40 if i % 3 == 0 else i % 2500
        n = k // 2
        reason = O.MISSING if k % 2 or n >= 1000 else O.DELETED if n % 10 == 0 else O.LATE if n > 500 else 0
        if reason:
            want[str(i)] = reason
    assert got == want
