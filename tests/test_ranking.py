import pytest
from pyspark.sql import functions as F

from codeloom.operators import bundle as B
from codeloom.operators import ranking as R
from codeloom.operators.graph import Graph


def test_hints_and_qualified_names():
    assert R.path_hints("fix `pkg/a.go`, (main.go) and pkg/a.go then stop") == ["pkg/a.go", "main.go"] and R.path_hints("") == []
    assert R.split_qualified("what does Ledger.flush do") == ("Ledger", "flush") and R.split_qualified("`A.b`") == ("A", "b")
    assert R.split_qualified("a/b.c.d and 1.5 e.g.") is None and R.split_qualified("") is None
    assert R.parse_kinds("Function, method,function") == ["function", "method"] and R.parse_kinds("") == []
    with pytest.raises(ValueError):
        R.parse_kinds("function,planet")


def test_names_and_texts(spark):
    d = spark.createDataFrame([("logError", "a.go", None), ("catalog", "b.css", "embeds=A"), (None, None, None), ("flushLedger", "crates/sched/expert_pool.rs", "fn flush()"), ("route_get_3", "x.go", ""), ("model", "crates/sched/expertPool.rs", "role=state")], "name string, path string, sig string")
    r = d.select(R.is_hub_utility(F.col("name")).alias("h"), R.embedding_text(F.col("name"), F.col("path"), F.col("sig")).alias("t"), R.is_synthetic(F.col("name"), F.col("path"), F.lit(None).cast("string")).alias("s")).collect()
    assert [x["h"] for x in r] == [True, True, False, False, False, False] and [x["s"] for x in r] == [False, True, False, False, True, False]
    assert r[3]["t"] == "flushLedger flush ledger fn flush()" and r[5]["t"] == "model sched expert pool" and r[2]["t"] == ""


def test_fused_reasons_and_expansions(spark, rows):
    a = spark.createDataFrame([("q", "1", 1, "lexical"), ("q", "2", 2, "lexical")], "query_id string, id string, rank int, reason string")
    b = spark.createDataFrame([("q", "1", 1, "vector"), ("q", "3", 2, "")], "query_id string, id string, rank int, reason string")
    got = {r["id"]: list(r["reasons"]) for r in R.rrf_reasons(a, b).collect()}
    assert got == {"1": ["lexical", "vector"], "2": ["lexical"], "3": ["rrf"]}
    t = spark.createDataFrame([("q", "x", 0.4), ("q", "x", 1.0), ("q", "y", 0.3)], "query_id string, term string, weight double")
    assert rows(R.merged_expansions(t, t.where("weight < 0.5"))) == [("q", "x", 1.0), ("q", "y", 0.3)]
    docs = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, doc string")
    stored = spark.createDataFrame([("1", "Sums up", ["Total"])], "id string, purpose string, aliases array<string>")
    assert rows(R.with_enrichment(docs, stored)) == [("1", "a sums up total"), ("2", "b")]


def small_graph(spark):
    s = spark.createDataFrame([("r", f"sym:{n}", n, "function", p, 1, 3, "go", None, None) for n, p in (("a", "a.go"), ("b", "b.go"), ("t", "a_test.go"))], "repo_id string, id string, name string, kind string, path string, line_start int, line_end int, language string, signature string, parent_id string")
    e = spark.createDataFrame([("r", "1", "calls", "sym:a", "sym:b", 1.0), ("r", "2", "calls", "sym:t", "sym:b", 1.0), ("r", "3", "calls", "sym:a", "sym:gone", 1.0), ("r", "4", "imports", "file:r:a.go", "mod:r:m", None)], "repo_id string, id string, kind string, src_id string, dst_id string, confidence double")
    return Graph(spark.createDataFrame([("r", "file:r:a.go", "a.go")], "repo_id string, id string, path string"), s, e)


def test_bundles(spark):
    g = small_graph(spark)
    got = {r["id"]: r for r in B.context_bundles(g, callers=1).collect()}
    assert got["sym:b"]["callers"] == ["sym:a"] and got["sym:b"]["tests"] == ["sym:t"] and got["sym:a"]["callees"] == ["sym:b"] and got["sym:a"]["imports"] == ["mod:r:m"] and got["sym:t"]["callers"] == []
    none = Graph(g.files.where("false"), g.symbols.where("false"), g.edges.where("false"))
    assert B.context_bundles(none).count() == 0


def test_source_slices(spark, rows):
    s = small_graph(spark).symbols.withColumn("line_end", F.when(F.col("name") == "b", 0).otherwise(F.col("line_end")))
    texts = spark.createDataFrame([("file:r:a.go", "1\r\n2\n3\n4"), ("file:r:b.go", "x\ny"), ("file:r:a_test.go", None)], "file_id string, text string")
    assert rows(B.source_slices(s, texts, 2)) == [("sym:a", "1\n2", 2), ("sym:b", "x\ny", 2)]


def test_neighbours_targets_and_golden_cases(spark, rows):
    g = small_graph(spark)
    hits = spark.createDataFrame([("q", "sym:b", 2.0, 1)], "query_id string, id string, score double, rank int")
    assert rows(B.dependency_neighbors(g, hits)) == [("q", "sym:a", 1, 1.8, 1), ("q", "sym:t", 1, 1.8, 2)]
    assert rows(B.bench_targets(g.symbols, 1, None)) == [("r", "a"), ("r", "b"), ("r", "t")] and B.bench_targets(g.symbols).count() == 0
    h = spark.createDataFrame([("q", "a/x.go", 1), ("q", "b/y.go", 2)], "query_id string, path string, rank int")
    c = spark.createDataFrame([("q", "Y.go"), ("q", "zz"), ("none", "a")], "query_id string, needle string")
    assert rows(B.golden_cases(h, c)) == [("none", False, 0, 1), ("q", False, 2, 1)]
    r = spark.createDataFrame([("s", "sym:a", 1), ("s", "sym:b", 2)], "seed string, node string, depth int")
    assert rows(B.must_update(r, g.symbols)) == [("s", "sym:a", 1)]
