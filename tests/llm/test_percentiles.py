import random

from pyspark.sql import functions as F

from codeloom.llm import percentiles as P
from codeloom.runtime import work_area


def run(spark, data, ps=(50, 95), tolerance=0):
    d = spark.createDataFrame(data, "tool string, ms long, lo int, p string")
    c = P.value_counts(d, ["tool"], "ms")
    return {(r["tool"], r["p"]): r["value"] for r in P.percentiles(c, ["tool"], list(ps), work_area(spark, "t"), tolerance).collect()}


def brute(data, ps=(50, 95)):
    out = {}
    for t in {r[0] for r in data}:
        v = sorted(r[1] for r in data if r[0] == t and r[1] is not None)
        for p in ps:
            if v:
                out[(t, p)] = v[p * (len(v) - 1) // 100]
    return out


def test_equals_sorting(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None, ""]), rnd.choice([rnd.randint(0, 100), int(rnd.paretovariate(0.5)), -5, 2**60]), 1, "x") for _ in range(3000)]
    data += [("tie", 7, 0, None)] * 50 + [("one", 3, 0, None), ("none", None, 0, None)]
    assert run(spark, data, (0, 50, 95, 100)) == brute(data, (0, 50, 95, 100))

def test_large_groups_lie_in_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_A_SHARD", 40)
    rnd = random.Random(4)
    data = [(rnd.choice(["a", "a", "a", None, "b"]), rnd.randint(0, 5000), 1, "x") for _ in range(2000)] + [("c", 1, 1, "x")]
    assert run(spark, data, (0, 50, 95, 100)) == brute(data, (0, 50, 95, 100))


def test_empty(spark):
    assert run(spark, []) == {} == run(spark, [("a", None, 1, "x")])


def test_tolerance_bounds_the_error(spark):
    data = [("a", i * 3, 1, "") for i in range(2000)]
    exact, near = brute(data), run(spark, data, tolerance=50)
    assert all(0 <= near[k] - exact[k] <= 50 for k in exact)


def test_parts_combine(spark):
    rnd = random.Random(3)
    data = [("a", rnd.randint(0, 999), 1, "") for _ in range(500)]
    d = spark.createDataFrame(data, "tool string, ms long, lo int, p string")
    parts = [P.value_counts(d.where(F.col("ms") % 3 == k), ["tool"], "ms") for k in range(3)]
    got = {(r["tool"], r["p"]): r["value"] for r in P.percentiles(P.merge_counts(*parts), ["tool"], [50, 95], work_area(spark, "t")).collect()}
    assert got == brute(data)


def test_tool_durations(spark, rows):
    data = [("1", " Ab ", "2020-01-05", "2020-01-05", 5), ("1", "Ab", "2020-01-05", "2020-01-04", 9), ("2", "x", "2020-01-06", "2020-01-06", -1), ("3", "x", "2020-01-06", "2020-01-06", None), (None, "x", "2020-01-06", "2020-01-06", 4), ("4", "X", "2020-01-06", "2020-01-06", 0)]
    d = spark.createDataFrame(data, "id string, tool_name string, called_at string, logged_at string, duration_ms long")
    d = d.withColumns({c: F.col(c).cast("timestamp") for c in ("called_at", "logged_at")})
    assert rows(P.tool_durations(d)) == [("ab", "2019-12-30", 5), ("x", "2020-01-06", 0)]
