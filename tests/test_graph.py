import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import contracts, evaluate, evolve, flows, graph, markdown, resolve, rules, search, traverse, upsert, usage

S = "repo_id string, id string, name string, kind string, path string, line_start int, line_end int, language string, signature string, parent_id string"
E = "repo_id string, id string, kind string, src_id string, dst_id string, confidence double"


@pytest.fixture(scope="module")
def g(spark):
    def sym(n, path="a/x.go", kind="function", parent=None, repo="r"):
        return (repo, f"sym:{n}", n, kind, path, 1, 9, "go", None, parent)

    syms = [sym("Hub", "core/hub.go"), sym("Mid"), sym("Leaf"), sym("c1"), sym("c2", "b/y.go"), sym("c3", "web/z_test.go"), sym("I", kind="interface"), sym("Do", kind="method", parent="I"), sym("T", kind="class"), sym("Do2", kind="method", parent="T"), ("r", "sym:DoT", "Do", "method", "a/x.go", 1, 9, "go", None, "T")]
    pairs = [("c1", "Hub"), ("c2", "Hub"), ("c3", "Hub"), ("c1", "Mid"), ("Mid", "Leaf")]
    edges = [("r", f"e{a}{b}", "calls", f"sym:{a}", f"sym:{b}", 0.8) for a, b in pairs]
    edges += [("r", "dup", "reads", "sym:c1", "sym:Hub", 0.5), ("r", "dangling", "calls", "sym:c1", "symref:r:a/x.go:Leaf", 0.5), ("r", "ext", "calls", "sym:c1", "symref:r:a/x.go:Printf", 0.5), ("r", "own", "calls", "sym:c2", "symref:r:b/y.go:Do", 0.5), ("r", "nul", None, None, None, None)]
    files = [("r", "file:r:a/x.go", "a/x.go", "go", 1, "h"), ("r", "file:r:b/y.go", "b/y.go", "go", 1, "h")]
    return graph.Graph(spark.createDataFrame(files, "repo_id string, id string, path string, language string, size_bytes long, hash string"), spark.createDataFrame(syms, S), spark.createDataFrame(edges, E))


def test_hubs_callers_and_dead_code(g, rows):
    assert [(r["name"], r["n_callers"]) for r in graph.top_hubs(g, 2).collect()] == [("Hub", 3), ("Leaf", 1)]
    assert [r["caller"] for r in graph.callers(g).where("callee = 'sym:Hub'").orderBy("caller").collect()] == ["sym:c1", "sym:c2", "sym:c3"]
    assert {r["callee"]: r["n_callers"] for r in graph.count_callers(g).where("callee LIKE 'sym:%'").collect()}["sym:Hub"] == 3
    assert "sym:Hub" not in {r["id"] for r in graph.unreferenced(g).collect()}
    assert rows(graph.package_hubs(g)) == [("r:core", 3, 3)]
    assert rows(graph.unresolved_split(g)) == [(2, 1)]
    assert rows(graph.implementations(g)) == [("r", "I", "T", 1, 1, True)]


def test_traversal(spark, g, rows):
    up = traverse.impact(g, spark.createDataFrame([("sym:Leaf",)], "seed string"), 3)
    assert rows(up.select("node", "depth")) == [("sym:Mid", 1), ("sym:c1", 2)]
    pairs = spark.createDataFrame([("sym:c1", "sym:Leaf"), ("sym:Leaf", "sym:c1"), ("sym:c2", "sym:c2")], "src string, dst string")
    assert rows(traverse.shortest_paths(g, pairs).select("src", "hops")) == [("sym:c1", 2), ("sym:c2", 0)]
    assert rows(traverse.affected_tests(g, spark.createDataFrame([("sym:Hub",)], "seed string"))) == [("sym:c3", 1)]
    assert traverse.impact(g, spark.createDataFrame([], "seed string")).count() == 0
    near = {r["node"]: r["score"] for r in traverse.expand_neighbors(g, spark.createDataFrame([("sym:Mid", 1.0)], "node string, score double")).collect()}
    assert near["sym:Leaf"] == pytest.approx(0.45) and "sym:Mid" not in near


def test_resolution_and_revert(spark, g, rows):
    assert rows(resolve.resolve(g).select("edge_id", "dst_id", "strategy")) == [("dangling", "sym:Leaf", "unique")]
    assert rows(resolve.resolution_stats(g)) == [(3, 1, 1, 1)]
    new = {r["id"]: r["dst_id"] for r in resolve.apply_resolutions(g, resolve.resolve(g)).collect()}
    assert new["e:r:sym:c1:calls:sym:Leaf"] == "sym:Leaf" and "dangling" not in new
    changed = spark.createDataFrame([("r", "core/hub.go")], "repo_id string, path string")
    back = {r["dst_id"] for r in resolve.revert_into(g, changed).where("kind IN ('calls','reads')").collect()}
    assert "sym:Hub" not in back and any(x.endswith(":Hub") for x in back)


def test_incremental_equals_full(spark, g, rows):
    """Turning references back and resolving again gives the edges of the start."""
    s = g.symbols.withColumn("id", F.concat_ws(":", F.lit("sym"), "repo_id", "path", F.lit("1"), "name"))
    of = lambda n: F.concat_ws(":", F.lit("sym"), F.lit("r"), F.lit({"Hub": "core/hub.go", "c2": "b/y.go"}.get(n, "a/x.go")), F.lit("1"), F.lit(n))
    e = spark.createDataFrame([("r", "calls", 0.9)], "repo_id string, kind string, confidence double").select("repo_id", "kind", of("c2").alias("src_id"), of("Hub").alias("dst_id"), "confidence")
    e = e.select("repo_id", F.concat_ws(":", F.lit("e"), "repo_id", "src_id", "kind", "dst_id").alias("id"), "kind", "src_id", "dst_id", "confidence")
    full = graph.Graph(g.files, s, e)
    reverted = graph.Graph(g.files, s, resolve.revert_into(full, spark.createDataFrame([("r", "core/hub.go")], "repo_id string, path string")))
    again = resolve.apply_resolutions(reverted, resolve.resolve(reverted))
    assert rows(again.select("id", "dst_id", "confidence")) == rows(e.select("id", "dst_id", "confidence"))


def test_upserts(spark, g, rows):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, at int, v int")
    new = spark.createDataFrame([("a", 2, 5), ("a", 3, 6), ("c", 1, 7), (None, 1, 1)], "id string, at int, v int")
    once = upsert.merge_last(old, new, ["id"], "at")
    assert rows(once) == [("a", 3, 6), ("b", 1, 1), ("c", 1, 7)] == rows(upsert.merge_last(once, new, ["id"], "at"))
    left = upsert.remove_paths(g, spark.createDataFrame([("r", "core/hub.go")], "repo_id string, path string"))
    assert left.edges.where("dst_id = 'sym:Hub'").count() == 0 and left.symbols.where("name = 'Hub'").count() == 0


def test_graph_files_round_trip(spark, g, tmp_path, rows):
    upsert.write_graph(g, str(tmp_path))
    again = upsert.read_graph(spark, str(tmp_path), "dst")
    assert rows(again.edges.select("id", "dst_id")) == rows(g.edges.select("id", "dst_id"))


def test_flows(g):
    found = flows.request_flows(g)
    assert found.columns == ["id", "name", "entry", "steps", "layers"] and flows.clusters(g, found).columns == ["name", "node"]


def test_evolution(spark, rows):
    c = spark.createDataFrame([(i, f) for i in range(3) for f in ("x", "y")] + [(3, "x"), (3, None)] + [(9, f"f{i}") for i in range(40)] + [(9, "x")], "commit_id int, file string")
    assert {r["file"]: r["n_commits"] for r in evolve.churn(c).collect()}["x"] == 5
    assert rows(evolve.cochange(c)) == [("x", "y", 3, 0.75), ("y", "x", 3, 1.0)]
    ch = spark.createDataFrame([("core", 50), ("active", 50), ("stable", 1), ("config", 30)], "file string, n_commits long")
    ce = spark.createDataFrame([("core", 200), ("active", 2), ("stable", 200)], "file string, degree long")
    top = evolve.hotspots(ch, ce).collect()
    assert [r["file"] for r in top][0] == "core" and len(top) == 3 and all(0 < r["score"] <= 1 for r in top)


def test_search(spark, rows):
    docs = spark.createDataFrame([("1", "ledger writer ledger"), ("2", "reader"), ("3", None), ("4", "")], "id string, doc string")
    assert [r["id"] for r in search.bm25(docs, {"q": "ledger of the", "none": "of the"}).collect()] == ["1"]
    assert search.trigram(docs, {"q": "reader", "short": "ab"}).collect()[0]["score"] == pytest.approx(4 / 9)
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "x", 1)], "query_id string, id string, rank int")
    got = {r["id"]: r["score"] for r in search.rrf(a, b).collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 161) and len(got) == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id long, v array<double>")
    top = search.nearest(v, v.where("id = 1").select(F.lit("q").alias("query_id"), "v"), 2)
    assert [(r["id"], r["score"]) for r in top.orderBy("rank").collect()] == [(1, 1.0), (5, 1.0)]


def test_evaluation(spark, rows):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "z", 1)], "query_id string, id string, rank int")
    want = spark.createDataFrame([("q", "b"), ("q", "c"), ("p", "y")], "query_id string, id string")
    m = {r["query_id"]: r for r in evaluate.rank_metrics(ranked, want).collect()}
    assert m["q"]["mrr"] == 0.5 and m["q"]["hit_1"] == 0 and m["q"]["recall"] == 0.5 and m["p"]["ndcg"] == 0
    t = spark.createDataFrame([("n", "1"), ("n", "2")], "k string, item string")
    assert rows(evaluate.set_accuracy(t, t.where("item = '1'"), "k")) == [("n", 1.0, 0.5, 0.666667)]


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (SELECT 1) SELECT * FROM a;", "select 'drop table x'", "explain select 1", "select 1 -- delete from x"])
def test_guard_lets_reads_pass(sql):
    rules.check_read_only(sql)


@pytest.mark.parametrize("sql", ["", "drop table x", "select 1; select 2", "with a as (delete from t returning *) select 1", "select * from t for update", "select 1 into outfile 'x'", "set x = 1", "/* select */ insert into t values (1)"])
def test_guard_stops_the_rest(sql):
    with pytest.raises(rules.NotReadOnly):
        rules.check_read_only(sql)


def test_guarded_query(spark):
    d, more = rules.guarded_query(spark, "select * from range(10)", 4)
    assert d.count() == 4 and more
    assert rules.rows_as_json(spark.sql("select 1 a, null b")).first()[0] == '{"a":"1","b":null}'


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
 keep
-old
+password = "hunter22"
+safe()
@@ -10 +11,2 @@
 z
+eval(x)
diff --git a/y.sql b/y.sql
--- /dev/null
+++ b/y.sql
@@ -0,0 +1 @@
+DROP TABLE t
"""


def test_diff_and_rules(spark, rows):
    added = rules.parse_diff(spark.createDataFrame([("d", DIFF), ("n", None), ("e", "")], "diff_id string, text string"))
    assert rows(added.select("file", "line", "content")) == [("x.py", 12, "eval(x)"), ("x.py", 2, 'password = "hunter22"'), ("x.py", 3, "safe()"), ("y.sql", 1, "DROP TABLE t")]
    hit = rules.scan_lines(added, rules.SECURITY_RULES)
    assert rows(hit.select("line", "rule")) == [(12, "dynamic-eval"), (2, "hardcoded-secret")]
    assert rows(rules.patch_critic(added, "eval(", ["safe("]).select("line")) == [(12,)]
    assert rows(rules.risk_scores(hit)) == [("x.py", 10, "high")]
    f = spark.createDataFrame([("a", 1, "x-1", "low"), ("a", 1, "x-2", "high")], "file string, line int, rule string, severity string")
    assert rows(rules.collapse(f)) == [("a", 1, "x-2", "high")] and rules.merge_findings(f, f).count() == 2


def test_markdown_and_budget(spark, rows):
    text = "# A\nbody\n```\n# not a heading\n```\n## B\n" + "\n\n".join(["word " * 300] * 4)
    got = markdown.chunk(text)
    assert got[0][0] == "A" and "# not a heading" in got[0][1] and len(got) == 5 and {h for h, _ in got[1:]} == {"B"}
    s = spark.createDataFrame([("g", 1, 5.0, 900), ("g", 2, 4.0, 50), ("g", 3, 3.0, 60)], "group string, pos int, score double, n_tokens long")
    assert [r["pos"] for r in markdown.within_budget(s, 950).orderBy("rank").collect()] == [1, 2]
    items = spark.createDataFrame([("g", "a", 9.0, 80, "implementation"), ("g", "b", 8.0, 40, "implementation"), ("g", "c", 7.0, 40, "test")], "group string, id string, score double, n_tokens long, kind string")
    assert {r["id"]: r["tier"] for r in markdown.greedy_pack(items, 100).collect()} == {"a": "excluded", "b": "must", "c": "should"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.split_identifier(F.lit("parseHTTPRequest2_fast"))) == ["parse", "http", "request", "fast"]
    assert one(T.tokenize(F.lit("A/b_c.d-e"))) == ["a", "b", "c", "d-e"]
    assert one(T.redact(F.lit("token=abc123 x"))) == "token=[REDACTED] x"
    assert one(T.html_to_text(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"
    assert one(T.singular(F.lit("queries"))) == "query" and one(T.singular(F.lit("boxes"))) == "box" and one(T.singular(F.lit("class"))) == "class"
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(T.cosine(a, b)) == pytest.approx(0.5**0.5) and one(T.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(T.hamming_similarity(T.quantize(a), T.quantize(b))) == pytest.approx(1 - 1 / 64)
    assert one(paths.dirname(F.lit("x"))) == "." and one(paths.subtree_root(F.lit("packages/a/b.ts"))) == "packages/a"
    assert one(paths.language_of(F.lit("a/B.TSX"))) == "typescript" and one(paths.language_of(F.lit("Dockerfile.dev"))) == "docker"


def test_contracts_and_memory(spark, rows):
    t = spark.createDataFrame([("r1", "a", "paths:\n  /v1/users:\n"), ("r2", "b", '  "/v1/users":\n'), ("r2", "c", "message Ping {\n"), ("r3", "d", None)], "repo_id string, path string, text string")
    assert rows(contracts.links(contracts.discover(t))) == [("http", "/v1/users", 2, 2)]
    m = spark.createDataFrame([("1", 1, "fix the ledger", 0.5), ("2", 2, None, 0.1)], "id string, ts int, text string, weight double")
    assert [r["id"] for r in usage.search_memory(m, "ledger bug").collect()] == ["1"]


def test_percentiles_of_groups_equal_sorting(spark):
    import random

    from codeloom.operators import evaluate

    rnd = random.Random(6)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randint(-5, 50), int(rnd.paretovariate(0.6)), 2.5])) for _ in range(1500)] + [("one", 3), ("none", None)]
    d = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in data], "g string, v double")
    got = {(r["g"], r["p"]): r["value"] for r in evaluate.index_percentile(d, ["g"], "v", [0, 50, 95, 100]).collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        v = sorted(float(x) for k, x in data if k == g and x is not None)
        want |= {(g, p): v[p * (len(v) - 1) // 100] for p in (0, 50, 95, 100)}
    assert got == want and evaluate.index_percentile(d.where("false"), ["g"], "v", [50]).count() == 0


def test_budget_keeps_the_best(spark):
    from codeloom.operators import markdown

    rows_ = [(g, i, s, n) for g in ("a", None) for i, (s, n) in enumerate([(5, 4), (9, 3), (5, 2), (1, 1), (7, 9)])] + [("big", 0, 1, 99)]
    d = spark.createDataFrame(rows_, "`group` string, pos long, score int, n_tokens long")
    got = sorted((str(r["group"]), r["pos"]) for r in markdown.within_budget(d, 12).collect())
    assert got == [("None", 1), ("None", 4), ("a", 1), ("a", 4), ("big", 0)]
