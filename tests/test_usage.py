import random

from pyspark.sql import functions as F

from codeloom.operators import usage


def test_sessions_equal_brute_force_across_spans(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("ab"), rnd.randint(0, 4000), i) for i in range(160)] + [("c", None, 900), (None, 5, 901), ("d", 7, 902)]
    e = spark.createDataFrame(data, "user string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["user"], r["session"]): (r["n"], int(r["first_ts"].timestamp()), int(r["last_ts"].timestamp())) for r in usage.sessions(e, 30, span_s=100).collect()}
    want = {}
    for u in "abd":
        k, last = 0, None
        for t in sorted(s for v, s, _ in data if v == u and s is not None):
            if last is None or t - last > 30:
                k += 1
                want[(u, k)] = (0, t, t)
            n, first, _ = want[(u, k)]
            want[(u, k)] = (n + 1, first, t)
            last = t
    assert got == want
    assert usage.sessions(e.where("false"), 30).count() == 0


def test_reports(spark, rows):
    c = spark.createDataFrame([("s", 1, "x", 10, False), ("s", 2, "y", 5, True), ("", 3, "x", None, False), (None, 3, "x", 7, False)], "session string, ts long, tool string, latency long, failed boolean")
    assert rows(usage.tool_report(c)) == [("x", 3, 0, 17, 8, 7, 10), ("y", 1, 1, 5, 5, 5, 5)]
    assert rows(usage.session_report(c).select("session", "n_calls", "n_errors", "n_tools", "last_tool", "total_ms")) == [("s", 2, 1, 2, "y", 15)]
