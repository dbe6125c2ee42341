from pyspark.sql import functions as F

from codeloom.operators import gates as G


def test_distance_budget_and_worst_risk(spark, rows):
    f = spark.createDataFrame([("r", "a/x.go", "k"), ("r", "b/x.go", "k"), ("r", "c/y.go", "k"), ("q", "a/x.go", "k")], "repo_id string, path string, rule string")
    c = spark.createDataFrame([("r", "a/x.go"), ("r", "a/x.go")], "repo_id string, path string")
    assert rows(G.finding_distance(f, c).select("repo_id", "path", "distance")) == [("q", "a/x.go", 2), ("r", "a/x.go", 0), ("r", "b/x.go", 1), ("r", "c/y.go", 2)]
    assert rows(G.change_budget(c, 1)) == [("r", 1, True)] and rows(G.change_budget(f.select("repo_id", "path"), 2)) == [("q", 1, True), ("r", 3, False)] and G.change_budget(f.select("repo_id", "path"), 0).where("within").count() == 2
    r = spark.createDataFrame([("a", "low"), ("a", "High"), ("a", None), ("b", "odd"), ("b", "medium")], "id string, risk string")
    assert rows(G.worst_risk(r, "id")) == [("a", "High"), ("b", "medium")]


def test_migration_guard(spark, rows):
    lines = ["DROP TABLE users;", "-- drop table x", "alter table t drop column c", "ALTER TABLE t ALTER c SET NOT NULL", "delete from t;", "delete from t where id = 1", "rename table a to b", "select 1", "", "truncate t"]
    d = spark.createDataFrame([("db/migrations/1.go", i, x) for i, x in enumerate(lines)] + [("src/app.go", 0, "drop table x"), ("a.SQL", 1, "drop index i")], "file string, line int, content string")
    got = {(r["file"], r["line"]): (r["rule"], r["severity"]) for r in G.migration_guard(d).collect()}
    assert got == {("db/migrations/1.go", 0): ("drop-table", "critical"), ("db/migrations/1.go", 2): ("alter-drop", "high"), ("db/migrations/1.go", 3): ("not-null", "high"), ("db/migrations/1.go", 4): ("delete-all", "high"), ("db/migrations/1.go", 6): ("rename", "medium"), ("db/migrations/1.go", 9): ("truncate", "critical"), ("a.SQL", 1): ("drop-key", "high")}


def test_readiness(spark, rows):
    mk = lambda rows_, s: spark.createDataFrame(rows_, s)
    got = G.readiness(mk([("a",), ("b",), ("b",), ("c",)], "repo_id string"), mk([("a", "high"), ("b", "low")], "repo_id string, severity string"), mk([("c",)], "repo_id string"), mk([("b",)], "repo_id string"))
    assert rows(got) == [("a", 1, 0, 0, False, "resolve blocking findings"), ("b", 0, 0, 1, True, "add tests for changed symbols"), ("c", 0, 1, 0, False, "resolve blocking findings")]


def test_surfaces_guidance_and_tiers(spark, rows):
    f = [("web", "src/routes/a.js"), ("lib", "src/a.py"), ("dj", "manage.py"), ("npm", "package.json"), ("none", None)] + [("c", f"src/f{i}.c") for i in range(16)]
    files = spark.createDataFrame(f, "repo_id string, path string")
    assert {r["repo_id"]: r["kind"] for r in G.http_surface(files).collect()} == {"web": "app", "lib": "unknown", "dj": "framework", "npm": "manifest", "none": "unknown", "c": "non_http"}
    shapes = spark.createDataFrame([("c", "library"), ("web", "app")], "repo_id string, shape string")
    assert rows(G.guidance(files, shapes, [("r", "library", r"f1\d?\.c"), ("s", "app", "zz")], 2)) == [("c", "r", "src/f1.c", 1), ("c", "r", "src/f10.c", 2)]
    t = spark.createDataFrame([("x", 0.5, 1, "explain"), ("x", 0.9, 1, "bugfix"), ("whole repo", 0.9, 1, "bugfix"), ("x", 0.9, 1, "review"), ("x", 0.8, 1, "review"), ("x", 0.8, 3, "feature"), ("x" * 200, 0.9, 3, "feature"), (None, None, 0, None), ("y", 0.75, 4, "explain")], "t string, c double, n int, i string")
    assert [r[0] for r in t.select(G.task_tier(F.col("t"), F.col("c"), F.col("n"), F.col("i"))).collect()] == ["deep", "fast", "deep", "standard", "deep", "standard", "fast", "deep", "fast"]


def test_imports(spark, rows):
    m = spark.createDataFrame([("src/a",), ("react",), ("@s/p",), ("github.com/a/b",), ("App\\User",), ("https://x/y",), ("/abs",)], "m string")
    assert [r[0] for r in m.select(G.repo_rooted(F.col("m"))).collect()] == [True, False, False, False, False, False, False]
    i = spark.createDataFrame([("f", "App\\Models\\User"), ("f", "App\\Other\\Post"), ("g", "plain/User")], "caller string, module string")
    c = spark.createDataFrame([("1", "User", "src/App/Models/User.php"), ("2", "User", "src/Tests/User.php"), ("3", "User", "App/Models/people.php"), ("4", "Post", "x\\App\\Other\\Post.php")], "id string, name string, path string")
    assert rows(G.namespaced_candidates(i, c)) == [("f", "1"), ("f", "4")]
    h = spark.createDataFrame([("User", "Models/")], "name string, hint string")
    assert [r["id"] for r in G.prefer_hinted(c, h).orderBy("id").collect()] == ["1", "3", "4"]
    man = spark.createDataFrame([("r", "go.mod", "module example.com/x\n\ngo 1.2"), ("r", "web/package.json", '{"name": "web"}'), ("r", "pyproject.toml", '[project]\nname = "py"'), ("r", "a.txt", "module no"), ("r", "go.mod", None)], "repo_id string, path string, text string")
    assert rows(G.import_roots(man)) == [("r", "example.com/x"), ("r", "py"), ("r", "web")]
    cfg = spark.createDataFrame([("r", '{"compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"], "@lib": ["./lib"]}}}'), ("r", "no json"), ("q", '{"compilerOptions": {"paths": {"~/*": ["*"]}}}')], "repo_id string, text string")
    assert rows(G.import_aliases(cfg)) == [("q", "~", ""), ("r", "@app", "src/app"), ("r", "@lib", "src/lib")]
    assert G.lock_version(["left-pad@1.2.3", "  react: 18.2.0"], "react") == "18.2.0" and G.lock_version(["react-dom@1.0.0"], "react") is None


def test_expanded_requests(spark, rows):
    t = spark.createDataFrame([("1",), ("2",)], "id string")
    s = spark.createDataFrame([("1", "p", 3)], "id string, pattern string, score int")
    r = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a")], "pattern string, requirement string")
    assert [(x["id"], x["pattern"], list(x["requirements"])) for x in G.expanded_requests(t, s, r, "other").orderBy("id").collect()] == [("1", "p", ["a", "b"]), ("2", "other", [])]
