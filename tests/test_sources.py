import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import resolve
from codeloom.sources import extract, trees
from codeloom.streaming import incremental


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("import os\n\nclass A(B):\n    def go(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n")
    (tmp_path / "pkg/b.go").write_text('package b\nimport "fmt"\nfunc Run() {\n\tfmt.Println(1)\n}\n')
    (tmp_path / "pkg/skip.py").write_text("x = 1\n")
    (tmp_path / "node_modules/x.js").write_text("x")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "pkg/a.py").write_text((tmp_path / "pkg/a.py").read_text() + "y = 2\n")
    git("commit", "-qam", "two")
    (tmp_path / "pkg/new.py").write_text("z = 3\n")
    return tmp_path


def test_tree_git_and_extraction(spark, repo):
    files = trees.source_files(spark, str(repo)).withColumn("repo_id", F.lit("r"))
    assert {r["path"] for r in files.collect()} == {"pkg/a.py", "pkg/b.go", "pkg/new.py"}
    assert {(r["file"]) for r in trees.commits(spark, str(repo)).collect()} >= {"pkg/a.py", "pkg/b.go"}
    assert ("?", "pkg/new.py") in {tuple(r) for r in trees.changes(spark, str(repo), "nonsense").collect()}
    rows = extract.extract(files)
    names = {(r["kind"], r["name"], r["parent_id"]) for r in rows.where("row = 'symbol'").collect()}
    assert names >= {("class", "A", None), ("method", "go", "A"), ("function", "helper", None), ("function", "Run", None)}
    assert {r["dst_id"] for r in rows.where("kind = 'imports'").collect()} == {"mod:r:os", "mod:r:fmt"}
    g = extract.as_graph(files, rows)
    assert "helper" in {r["dst_id"].split(":")[-1] for r in resolve.resolve(g).collect()}


def test_broken_python_falls_back(spark):
    d = spark.createDataFrame([("r", "x.py", "python", "def ok():\n  (\n"), ("r", "y.py", "python", None)], "repo_id string, path string, language string, content string")
    assert [r["name"] for r in extract.extract(d).where("row = 'symbol'").collect()] == ["ok"]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.log", "a/b.log", True), ("/x", "a/x", False), ("build/", "a/build/c", True), ("a/**/z", "a/b/c/z", True), ("doc?.md", "docs.md", True)])
def test_ignore_patterns(pattern, path, hit):
    assert trees.compiled([pattern])(path) is hit


def test_ignore_exceptions():
    assert not trees.compiled(["*.log", "!keep.log"])("keep.log")


def test_json_sources(spark, tmp_path):
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"runs": [{"results": [{"ruleId": "r1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 3}}}]}]}]}))
    assert [tuple(r) for r in trees.sarif(spark, str(s)).collect()] == [("r1", "warning", "f", 3, "m")]
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"queries": [{"id": "1", "query": "x", "relevant": ["a", "b"]}]}))
    assert trees.qrels(spark, str(q)).count() == 2
    u = tmp_path / "u.jsonl"
    u.write_text('{"tool": "a", "latency_ms": 3}\nbroken\n')
    assert trees.usage_log(spark, str(u)).count() == 1
    (tmp_path / "log").write_text("\n".join(map(str, range(9))) + "\n")
    assert [tuple(r) for r in trees.log_tail(spark, str(tmp_path / "log"), 2).collect()] == [(8, "7"), (9, "8")]
    pins = spark.createDataFrame([("go.sum", "a.b/c v1.2.0 h1:xx\na.b/c v1.2.0/go.mod h1:yy\n"), ("x/Cargo.lock", 'name = "serde"\nversion = "1.0"\n'), ("q", None)], "path string, content string")
    assert {tuple(r) for r in trees.lock_pins(pins).collect()} == {("go.sum", "a.b/c", "1.2.0"), ("x/Cargo.lock", "serde", "1.0")}


def test_debounce():
    done, (paths, _, _) = incremental.debounce_batches([(0, "a"), (50, "b"), (100, "c"), (400, "d"), (1000, "e")])
    assert done == [(0, 400, ["a", "b", "c", "d"], "debounce")] and paths == ["e"]
    assert incremental.debounce_batches([(i * 80, f"p{i}") for i in range(60)])[0][0][3] == "max_wait"
    assert incremental.debounce_batches([(0, f"p{i}") for i in range(512)])[0][0][3] == "full"


def test_debounce_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "source string, ts timestamp, path string"
    ev = [("s", f"2024-01-01 00:00:00.{ms:03d}", p) for ms, p in ((0, "a"), (50, "b"), (100, "c"))] + [("s", "2024-01-01 00:00:30.000", "z"), ("s", "2024-01-01 00:01:30.000", "y")]
    spark.createDataFrame(ev, "source string, t string, path string").select("source", F.col("t").cast("timestamp").alias("ts"), "path").coalesce(1).write.parquet(src)
    q = incremental.debounced(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(list(r["paths"]), r["reason"]) for r in spark.table("deb").orderBy("first_ms").collect()][0] == (["a", "b", "c"], "debounce")


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, at long, v long"
    for n, data in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 5), ("a", 1, 9)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{src}")
        q = incremental.upsert_stream(spark.readStream.schema(schema).parquet(src), out, ["id"], "at", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r["id"], r["v"]) for r in incremental.read_table(spark, out, ["id"]).collect()} == {("a", 5), ("b", 1)}


def test_changed_files(spark, rows):
    a = spark.createDataFrame([("r", "x", "1"), ("r", "y", "2"), ("r", "z", None)], "repo_id string, path string, hash string")
    b = spark.createDataFrame([("r", "x", "1"), ("r", "y", "3"), ("r", "z", None), ("r", "w", "4")], "repo_id string, path string, hash string")
    assert rows(incremental.changed_files(a, b)) == [("r", "w", "deleted"), ("r", "y", "changed"), ("r", "z", "changed")]


def test_external_database_and_catalog(spark):
    url = "jdbc:derby:memory:codeloom;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(5).selectExpr("id AS n").write.jdbc(url, "t", mode="overwrite", properties={"driver": driver})
    got = trees.jdbc_query(spark, url, 'select "n" from t where "n" > 1', limit=2, driver=driver)
    assert got.count() == 2 and {r[0] for r in got.collect()} <= {2, 3, 4}
    from codeloom.operators.rules import NotReadOnly

    with pytest.raises(NotReadOnly):
        trees.jdbc_query(spark, url, "delete from t", driver=driver)
    spark.range(1).selectExpr("id AS k", "'x' AS v").createOrReplaceTempView("cat_t")
    assert {tuple(r)[:3] for r in trees.catalog_schema(spark, ["cat_t"]).collect()} == {("cat_t", "k", "bigint"), ("cat_t", "v", "string")}
    spark.catalog.dropTempView("cat_t")


def test_grep_diff_and_ignores(spark, repo):
    hits = trees.grep(spark, str(repo / "pkg"), "helper")
    assert [(r["line"], r["is_definition"]) for r in hits.collect()] == [(7, True), (5, False)] and trees.grep(spark, str(repo / "pkg"), "help").count() == 0
    (repo / "pkg/b.go").write_text("package b\n")
    d = trees.unified_diff(spark, str(repo)).first()
    assert d["diff_id"] == "HEAD" and "-func Run() {" in d["text"]
    (repo / "pkg/.gitignore").write_text("# c\n\n*.tmp\n!keep.tmp\n/only\n")
    rules = trees.load_ignores(str(repo))
    match = trees.compiled(rules)
    assert match("skip.py") and match("pkg/a.tmp") and not match("pkg/keep.tmp") and not match("a.tmp") and match("pkg/x/b.tmp") and match("pkg/only") and not match("pkg/x/only")


def test_transcripts_and_golden_cases(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in [{"session": "a", "ts": "2024-01-01T00:00:00Z", "tokens": 5, "cumulative": False}, {"session": "a", "ts": "2024-01-01T00:00:01Z", "tokens": 7, "cumulative": False}, {"session": "b", "ts": "2024-01-01T00:00:00Z", "tokens": 5, "cumulative": True}, {"session": "b", "ts": "2024-01-01T00:00:09Z", "tokens": 9, "cumulative": True}, {"tokens": 3}]) + "\nbroken\n")
    assert {tuple(r) for r in trees.session_totals(spark, str(f)).collect()} == {("a", 12), ("b", 9)}
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"cases": [{"query": "q", "must_contain_path": ["a", "b"], "top_k": 3}]}))
    assert [(r["query"], list(r["must_contain_path"]), r["top_k"]) for r in trees.golden_suite(spark, str(g)).collect()] == [("q", ["a", "b"], 3)]


def test_rename_scale_and_session_batches(spark, rows, tmp_path):
    from codeloom.operators import search, upsert

    s = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    assert rows(upsert.rename_symbol(s, "2", "c")) == [("1", "a"), ("2", "c")]
    d = spark.createDataFrame([("q", 1.0), ("q", 3.0), ("r", 2.0)], "query_id string, score double")
    assert rows(search.min_max(d)) == [("q", 0.0), ("q", 1.0), ("r", 1.0)]
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("s", t, "b"), ("s", t + dt.timedelta(milliseconds=100), "a"), ("s", t + dt.timedelta(seconds=60), "c")], "source string, ts timestamp, path string")
    assert sorted(list(r["paths"]) for r in incremental.session_batches(e).collect()) == [["a", "b"], ["c"]]
