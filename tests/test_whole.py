"""Queries and operators that do the whole job where a cut was."""

from pyspark.sql import functions as F

from codeloom.operators import evaluate, evolve, hierarchy, search


def test_days_of_many_files_count(spark, rows):
    commits = spark.createDataFrame([(f"r@{day}", f"f{i:02d}") for day in (1, 2) for i in range(40)] + [("r@1", "once")], "commit_id string, file string")
    got = rows(evolve.cochange(commits, None, min_support=2))
    assert len(got) == 40 * 39 and got[0] == ("f00", "f01", 2, 1.0) and not any("once" in r for r in got)
    assert rows(evolve.cochange(commits, min_support=2)) == []


def test_every_function_and_method_is_searched_in_its_repository(spark):
    names = [("r", f"s{i:03d}", f"loadItem{chr(97 + i // 26) * 2}{chr(97 + i % 26) * 2}", "function" if i % 2 else "method") for i in range(90)]
    names += [("r", "a1", "flushLedger", "class"), ("r", "a2", "flush_ledger", "method"), ("q", "a3", "flush_ledger", "function"), ("q", "a0", "flush_ledger_all", "class"), ("q", "b1", "twice", "method"), ("q", "b2", "twice", "function"), ("q", "b3", "x", "function")]
    got = {r["repo_id"]: tuple(r)[1:] for r in evaluate.self_retrieval(spark.createDataFrame(names, "repo_id string, id string, name string, kind string")).collect()}
    # a2 comes after a1, which has the same words; x has no words
    assert got == {"r": (91, round(90 / 91, 6), 1.0, round(90.5 / 91, 6)), "q": (2, 0.5, 0.5, 0.5)}


def test_all_descendants_of_symbols(spark, rows):
    data = [("sym:0", None), ("sym:1", "sym:0"), ("sym:2", "sym:1"), ("sym:3", "sym:0"), ("sym:4", "sym:5"), ("sym:5", "sym:4"), ("sym:6", "sym:4"), ("sym:7", "sym:99")]
    d = spark.createDataFrame([("r", i, i, "method", "p", up) for i, up in data], "repo_id string, id string, name string, kind string, path string, parent_id string").selectExpr("*", "timestamp'2020-01-01' AS indexed_at")
    assert rows(hierarchy.symbol_descendants(d)) == [("sym:0", "sym:1", 1), ("sym:0", "sym:2", 2), ("sym:0", "sym:3", 1), ("sym:1", "sym:2", 1)]


def test_every_hashed_symbol_is_a_query(spark):
    names = ["flushLedger", "ledgerFlush", "splitLedger", "flush", "mergeInvoice"]
    s = spark.createDataFrame([(f"s{i:04d}", names[i * i % 5], ("function", "method", None)[i % 3], f"d{i % 7}/a.py") for i in range(900)], "id string, name string, kind string, path string")
    asked = {r["id"] for r in s.where(search.hashed()).collect()}
    got = search.similar_of(s, s.where(search.hashed())).collect()
    assert len(asked) > 1 and {r["query_id"] for r in got} == asked and len(got) == 10 * len(asked)
    r = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in got}
    assert all(r[q, k][1] >= r[q, k + 1][1] for q in asked for k in range(1, 10))
