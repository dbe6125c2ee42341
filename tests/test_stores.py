import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import freshness as FR
from codeloom.operators import stores as S
from codeloom.runtime import work_area


def at(spark):
    return work_area(spark, "t").root


def held(t):
    d = t.read()
    return {(r["k"], r["v"]) for r in d.collect()} if d is not None else set()


def test_changes_equal_a_dictionary(spark):
    rnd, folder, want = random.Random(2), at(spark), {}
    mk = lambda rows: spark.createDataFrame(rows, "k string, v int, bucket2 string, at int")
    for turn in range(3):
        t = S.KeyedTable(spark, folder, ["k"], buckets=4)  # opened again each time
        batch = {f"k{rnd.randrange(12)}": rnd.randrange(100) for _ in range(6)}
        t.upsert(mk([(k, v - 1, "x", 0) for k, v in batch.items()] + [(k, v, "x", 1) for k, v in batch.items()] + [(None, 5, "x", 9)]), "at")
        want |= batch
        gone = rnd.choice(sorted(want))
        t.delete(spark.createDataFrame([(gone,), ("never",)], "k string"))
        want.pop(gone)
        assert held(S.KeyedTable(spark, folder, ["k"])) == set(want.items())
    t.vacuum()
    assert held(S.KeyedTable(spark, folder, ["k"])) == set(want.items())


def test_append_replace_and_empty(spark):
    t = S.KeyedTable(spark, at(spark), ["g", "k"], ["g"], buckets=4)
    assert t.read() is None
    t.delete(spark.createDataFrame([("a",)], "g string"))
    mk = lambda rows: spark.createDataFrame(rows, "g string, k string, v int")
    t.append(mk([("a", "1", 1), ("b", "1", 1)]))
    t.append(mk([("a", "1", 1)]))
    assert held(t) == {("1", 1)} and t.read().count() == 3
    t.replace(mk([("a", "9", 9), ("c", "0", 0)]), mk([("a", "", 0)]))  # rows of other groups are not taken
    assert sorted((r["g"], r["k"]) for r in t.read().collect()) == [("a", "9"), ("b", "1")]
    t.replace(mk([]), mk([("b", "", 0)]))
    t.delete(spark.createDataFrame([("9",)], "k string"))  # by another key than the bucket's
    assert t.read().count() == 0


def test_only_touched_buckets_change_and_writers_meet(spark):
    folder = at(spark)
    t = S.KeyedTable(spark, folder, ["k"], buckets=16)
    t.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"))
    before, other = dict(t.parts), S.KeyedTable(spark, folder, ["k"])
    t.upsert(spark.createDataFrame([("k3", 33)], "k string, v int"))
    assert sum(t.parts[b] != before[b] for b in before) == 1 and t.read().count() == 100
    with pytest.raises(FileExistsError):
        other.upsert(spark.createDataFrame([("k4", 44)], "k string, v int"))
    assert ("k4", 4) in held(S.KeyedTable(spark, folder, ["k"]))


def test_a_batch_number_is_kept(spark):
    t = S.KeyedTable(spark, at(spark), ["k"])
    t.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), batch=7)
    assert S.KeyedTable(spark, t.folder, ["k"]).batch == 7


def test_plans_order_and_freshness(spark, rows):
    files = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "a"), ("q", "x"), ("n", "y")], "repo_id string, path string")
    changed = spark.createDataFrame([("r", "b"), ("r", "gone"), ("q", "x")], "repo_id string, path string")
    assert rows(FR.stable_order(changed, files)) == [("q", "x", 1), ("r", "b", 1)]
    assert {r["repo_id"]: r["mode"] for r in FR.index_plan(files, changed).collect()} == {"r": "full", "q": "full", "n": "none"}
    indexed = spark.createDataFrame([("a", "c1", "1", 5), ("b", "c0", "1", 5), ("c", "c1", "0", 5), ("d", "c1", "1", 5)], "repo_id string, commit string, version string, indexed_at int")
    heads = spark.createDataFrame([(x, "c1") for x in "abcde"], "repo_id string, head string")
    edited = spark.createDataFrame([("a", 5), ("d", 6)], "repo_id string, edited_at int")
    got = {r["repo_id"]: r["reason"] for r in FR.freshness(indexed, heads, edited, "1").collect()}
    assert got == {"a": None, "b": "head moved", "c": "version changed", "d": "files changed", "e": "no index"}


def test_intake_requeue_and_resync(spark, rows):
    e = spark.createDataFrame([("s", "write", "a.go"), ("s", "write", "a.go"), ("s", "chmod", "b.go"), ("s", "create", ".git/x"), ("t", "remove", "c.go"), ("t", "write", None), ("t", "write", "")], "source string, op string, path string")
    waiting = FR.intake(e)
    assert rows(waiting) == [("s", "a.go"), ("t", "c.go")]
    lost = spark.createDataFrame([("t", FR.OVERFLOW), ("s", "a.go")], "source string, path string")
    again = FR.requeue(waiting, lost)
    files = spark.createDataFrame([("t", "c.go"), ("t", "d.go"), ("s", "z.go")], "source string, path string")
    assert rows(FR.resync(again, files)) == [("s", "a.go"), ("t", "c.go"), ("t", "d.go")]
    p = spark.createDataFrame([(i, f"f{i}.{'go' if i % 2 else 'bin'}") for i in range(9)], "pos int, path string")
    assert [r["pos"] for r in FR.source_files(p, r"\.go$", 2).collect()] == [1, 3]


def test_query_cache():
    now, made = [0.0], []

    class D:
        def collect(self):
            made.append(1)
            return [len(made)]

    c = FR.QueryCache(15, 2, lambda: now[0])
    assert c.get("a", D) == [1] == c.get("a", D)
    now[0] = 20
    assert c.get("a", D) == [2] and c.get("b", D) == [3] and c.get("a", D) == [2] and c.get("c", D) == [4] and c.get("b", D) == [5]


def test_cached_graph_notices_changes(spark, tmp_path):
    import shutil

    src = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(src):
        pytest.skip("no test tables here")
    for t in ("files", "symbols", "sdk_symbols", "edges"):
        shutil.copy(f"{src}/{t}.parquet", tmp_path)
    g = FR.cached_graph(spark, str(tmp_path))
    assert FR.cached_graph(spark, str(tmp_path)) is g
    (tmp_path / "new.txt").write_text("x")
    assert FR.cached_graph(spark, str(tmp_path)) is not g


def test_artifacts_and_statistics(spark, rows):
    d = spark.createDataFrame([("r", f"s{i}", i) for i in range(12)], "repo_id string, id string, n long")
    got = S.hub_artifact(d, d, 2, 1)
    assert rows(got) == [("r", "package", "s11", 11, 1), ("r", "symbol", "s10", 10, 2), ("r", "symbol", "s11", 11, 1)]
    t = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(S.table_statistics(t, "k")) == [(3, 1, 1)] and rows(S.table_statistics(t.where("false"), "k")) == [(0, 0, 0)]
    assert F is not None
