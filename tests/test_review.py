from pyspark.sql import functions as F

from codeloom.operators import docs, graph, review
from tests.test_graph import E, S


def g_of(spark, syms, edges=(), files=()):
    return graph.Graph(spark.createDataFrame(list(files), "repo_id string, id string, path string, language string"), spark.createDataFrame(syms, S), spark.createDataFrame(list(edges), E))


def sym(i, name, path="a/x.go", kind="function", parent=None):
    return ("r", i, name, kind, path, 1, 9, "go", None, parent)


def test_gap_needs_a_sibling_test(spark, rows):
    files = [("r", f"f{i}", p, "go") for i, p in enumerate(["a/x.go", "a/x_test.go", "b/y.go", "c/billing/z.py", "c/billing/tests/test_z.py"])]
    g = g_of(spark, [sym("1", "f"), sym("2", "g", "b/y.go"), sym("3", "h", "c/billing/z.py"), sym("4", "K", "b/y.go", "class")], files=files)
    changed = g.files.select("repo_id", "path")
    assert rows(review.test_gap(g, changed)) == [("2", "g", "b/y.go", "behaviour")]
    assert rows(review.contract_guard(g, changed).select("name")) == [("K",)]


def test_disambiguation(spark, rows):
    s = [sym("1", "only"), sym("2", "two"), sym("3", "two", "tests/two.go"), sym("4", "hot"), sym("5", "hot", "b.go"), sym("6", "tie"), sym("7", "tie", "b.go")]
    e = [("r", f"e{i}", "calls", f"s{i}", "4", 1.0) for i in range(4)] + [("r", "e9", "calls", "s1", "5", 1.0)]
    got = review.disambiguate(g_of(spark, s, e), spark.createDataFrame([(n,) for n in ("only", "two", "hot", "tie", "none")], "name string"))
    assert rows(got) == [("hot", "4", "fan_in"), ("only", "1", "only"), ("two", "2", "non_fixture")]


def test_promoted_methods(spark, rows):
    m = spark.createDataFrame([("B", "go", "1"), ("C", "go", "2"), ("C", "run", "3"), ("D", "run", "4"), ("A", "own", "5"), ("B", "own", "6")], "type string, method string, id string")
    e = spark.createDataFrame([("A", "B"), ("A", "X"), ("X", "C"), ("X", "D"), ("D", "A")], "type string, embedded string")
    assert rows(review.promoted_methods(m, e).where("type = 'A'")) == [("A", "go", "1", 1)]


def test_aliases_and_embeds(spark, rows):
    i = spark.createDataFrame([("r", "f", "@/ui/button"), ("r", "f", "@/x"), ("r", "f", "react")], "repo_id string, src_id string, module string")
    a = spark.createDataFrame([("r", "@", "src"), ("r", "@/ui", "packages/ui")], "repo_id string, alias string, target string")
    assert rows(review.expand_aliases(i, a).select("module", "resolved")) == [("@/ui/button", "packages/ui/button"), ("@/x", "src/x")]
    s = spark.createDataFrame([("T", "type T embeds=A,B x"), ("U", None)], "name string, signature string")
    assert rows(review.embeds_of(s)) == [("T", "A"), ("T", "B")]


def test_enrichment_skips_what_fits(spark):
    s = spark.createDataFrame([("1", "a", None, "function"), ("2", "b", "sig", "function")], "id string, name string, signature string, kind string")
    _, new = review.enrich(s, spark.createDataFrame([], "id string, hash string, purpose string"), lambda b: b.assign(purpose="p")[["id", "hash", "purpose"]])
    cached, again = review.enrich(s.withColumn("name", F.when(F.col("id") == "2", "c").otherwise(F.col("name"))), new, lambda b: b.assign(purpose="q")[["id", "hash", "purpose"]])
    assert [r["id"] for r in cached.collect()] == ["1"] and [r["id"] for r in again.collect()] == ["2"]


def test_dataflow(spark, rows):
    lines = spark.createDataFrame([("f", 1, "query('x' + uid)"), ("f", 2, "uid = request.args['u']"), ("f", 3, "db.execute('select ' + uid)"), ("f", 4, "execute(safe)"), ("g", 3, "execute(uid)"), ("g", 4, None)], "file string, line int, content string")
    assert rows(review.dataflow(lines)) == [("f", 3, "sql", "uid")]


def test_classification(spark, rows):
    t = spark.createDataFrame([("1", "Fix the ledger"), ("2", None), ("3", "nothing")], "id string, text string")
    assert rows(review.classify(t, {"bugfix": ["fix"], "build": ["add"]})) == [("1", "bugfix", 1), ("2", "explain", 0), ("3", "explain", 0)]
    assert rows(review.select_pattern(t, {"a": ["fix"], "b": ["ledger"]})) == [("1", "b", 6)]


def test_enclosing_and_owners(spark, rows):
    s = spark.createDataFrame([("r", "p", "out", 1, 50), ("r", "p", "in", 5, 9), ("r", "p", "late", 60, 61)], "repo_id string, path string, id string, line_start int, line_end int")
    p = spark.createDataFrame([("r", "p", 6), ("r", "p", 55), ("r", "q", 1)], "repo_id string, path string, line int")
    assert rows(graph.enclosing_symbols(s, p)) == [("r", "p", 55, "in", False), ("r", "p", 6, "in", True)]
    i = spark.createDataFrame([("r", "Lib/core/x"), ("r", "zed")], "repo_id string, module string")
    o = spark.createDataFrame([("q", "lib"), ("w", "lib/core"), ("r", "zed")], "owner string, root string")
    assert rows(graph.resolve_owners(i, o)) == [("r", "Lib/core/x", "w")]


def test_links_and_compact(spark):
    d = spark.createDataFrame([("d", "# X\n## API\n- [Auth guide](http://a): tokens\n- [Queue](http://q)\n"), ("e", None)], "id string, text string")
    links = docs.link_index(d)
    assert [(r["section"], r["title"], r["url"]) for r in links.orderBy("pos").collect()] == [("API", "Auth guide", "http://a"), ("API", "Queue", "http://q")]
    assert [r["title"] for r in docs.select_links(links, "auth token").collect()] == ["Auth guide"]
    assert docs.compact({"a": 1, "b": [{"x": 1, "y": "p,q"}, {"x": 2, "y": None}], "c": [1, "two"], "d": {"e": "true"}}) == 'a: 1\nb[2]{x,y}:\n  1,"p,q"\n  2,null\nc[2]: 1,two\nd:\n  e: "true"'
