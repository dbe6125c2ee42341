import datetime as dt

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import docs, evolve, flows, indexing, ranking, upsert
from codeloom.operators import stores as S
from codeloom.runtime import work_area

FILES = "repo_id string, path string, language string, content string, hash int"


def mk(spark, data):
    return spark.createDataFrame([(*d, 1) for d in data], FILES).drop("hash")


def test_runs_index_only_what_changed(spark, rows):
    at = work_area(spark, "t").root
    a, b, c = ("r", "a.go", "go", "func run() { stop() }\n"), ("r", "b.go", "go", "func stop() {\n}\n"), ("r", "c.go", "go", "const Max = 3\n")
    d = ("q", "x.py", "python", "def f():\n    return g()\n")
    first = indexing.index_run(spark, mk(spark, [a, b, c, d, (None, "z", "go", "x")]), at, buckets=8)
    assert {(r["repo_id"], r["n_changed"], r["mode"]) for r in first.collect()} == {("r", 3, "full"), ("q", 1, "full")}
    g = indexing.index_graph(spark, at)
    assert {r["name"] for r in g.symbols.collect()} == {"run", "stop", "Max", "f"} and g.edges.where("kind = 'calls'").count() == 2
    before = dict(indexing.tables(spark, at)[1].parts)
    b2 = ("r", "b.go", "go", "func halt() {\n}\n")
    second = indexing.index_run(spark, mk(spark, [a, b2, c, d]), at, buckets=8)
    assert {(r["repo_id"], r["n_changed"], r["mode"]) for r in second.collect()} == {("r", 1, "incremental"), ("q", 0, "none")}
    assert {r["name"] for r in indexing.index_graph(spark, at).symbols.collect()} == {"run", "halt", "Max", "f"}
    after = indexing.tables(spark, at)[1].parts
    assert sum(after.get(k) != before.get(k) for k in set(before) | set(after)) <= 1
    indexing.index_run(spark, mk(spark, [a, b2, c]), at, buckets=8)
    g = indexing.index_graph(spark, at)
    assert {r["path"] for r in g.files.collect()} == {"a.go", "b.go", "c.go"} and g.symbols.where("path = 'x.py'").count() == 0
    assert {r["mode"] for r in indexing.index_run(spark, mk(spark, [a, b2, c]), at, buckets=8).collect()} == {"none"}


def test_empty_index(spark):
    at = work_area(spark, "t").root
    assert indexing.index_graph(spark, at).symbols.count() == 0
    indexing.index_run(spark, mk(spark, []), at)
    assert indexing.index_graph(spark, at).files.count() == 0


def test_watch_debounces_relevant_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    e = [("s", t, "write", "a.go"), ("s", t + dt.timedelta(milliseconds=50), "write", "b.go"), ("s", t + dt.timedelta(seconds=20), "chmod", "no"), ("s", t + dt.timedelta(seconds=20), "write", ".git/x"), ("s", t + dt.timedelta(seconds=40), "write", "c.go"), ("s", t + dt.timedelta(seconds=90), "write", "d.go")]
    schema = "source string, ts timestamp, op string, path string"
    for i, part in enumerate((e[:4], e[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = []
    q = indexing.watch(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lambda b, n: got.extend(list(r["paths"]) for r in b.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ["a.go", "b.go"] in got and not any("no" in p or ".git/x" in p for p in got)


def test_flows_are_persisted(spark):
    from tests.test_ranking import small_graph

    g = small_graph(spark)
    g.symbols = g.symbols.withColumn("path", F.when(F.col("name") == "a", "x/routes/a.go").otherwise("x/services/b.go"))
    tables = S.KeyedTable(spark, work_area(spark, "t").root, ["repo_id", "id"], ["repo_id"]), S.KeyedTable(spark, work_area(spark, "t").root, ["repo_id", "name"], ["repo_id"])
    flows.persist(g, *tables)
    assert [list(r["steps"]) for r in tables[0].read().collect()] == [["sym:a", "sym:b"]]
    assert {(r["name"], r["n_members"], r["cohesion"]) for r in tables[1].read().collect()} >= {("layer:route", 1, 0.6), ("layer:service", 1, 0.75)}
    flows.persist(g, *tables)
    assert tables[0].read().count() == 1


def test_small_forms(spark, rows, tmp_path):
    d = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}]}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in d.select(T.json_path(F.col("j"), "a.b.1.c")).collect()] == ["x", None, None]
    docs_ = spark.createDataFrame([("1", "ab"), ("2", None), ("3", "")], "id string, body string")
    assert rows(ranking.embedded(docs_, lambda texts: [[len(t), 1] for t in texts], 1)) == [("1", [2.0, 1.0]), ("2", None), ("3", [0.0, 1.0])]
    k = spark.createDataFrame([("b", 2), ("a", 3), ("a", 1), ("", 0), (None, 0)], "k string, n int")
    assert [tuple(r) for r in ranking.first_distinct(k, "k", "n", 5).orderBy("n").collect()] == [("a", 1), ("b", 2)]
    s = spark.createDataFrame([("a", 2, "u2"), ("a", 1, "u1"), ("b", 1, None)], "name string, priority int, url string")
    assert rows(docs.resolved_sources(s, s, "any/{}")) == [("a", "u1", "listed"), ("b", "any/b", "derived")]
    r = spark.createDataFrame([("f", "x", 3, 0.5), ("f", "y", 3, 0.9), ("g", "x", 1, 1.0)], "file string, other string, support long, confidence double")
    assert [x["other"] for x in evolve.cochanged_with(r, r.where("file = 'f'"), 1).collect()] == ["y"]
    from tests.test_ranking import small_graph

    upsert.write_merged(small_graph(spark), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
