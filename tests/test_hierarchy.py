import random

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H


def brute(parent):
    """node -> (root, depth, path) by walking up."""
    out = {}
    for n in parent:
        path, seen, at = [n], {n}, n
        while parent.get(at) is not None and parent.get(at) in parent:
            at = parent[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        out[n] = ("cycle", -1, None) if path is None else (at, len(path) - 1, tuple(reversed(path)))
    return out


def run(spark, parent):
    nodes = spark.createDataFrame([(n,) for n in parent], "key string")
    links = spark.createDataFrame([(n, p) for n, p in parent.items() if p is not None], "key string, parent_key string")
    got = H.hierarchy(nodes, links, paths=True)
    return got, {r["key"]: (r["root_key"], r["depth"], tuple(r["path"]) if r["path"] is not None else None) for r in got.collect()}


def test_chain_tree_ring_and_below(spark):
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(24)}  # a chain
    parent |= {f"t{i}": f"t{(i - 1) // 3}" if i else None for i in range(40)}  # a bushy tree
    parent |= {"r0": "r2", "r1": "r0", "r2": "r1", "below": "r1", "deep": "below", "self": "self"}  # rings
    parent |= {"lost": "nowhere"}
    got, found = run(spark, parent)
    assert found == brute(parent)
    d = {(r["ancestor"], r["descendant"]): r["steps"] for r in H.descendants(got).collect()}
    assert d[("c0", "c23")] == 23 and ("c23", "c0") not in d and not any("r1" in k for k in d)
    assert sum(1 for k in d if k[0] == "t0") == 39


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
@example(144)
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 50)
    parent = {str(i): rnd.choice([None, str(rnd.randrange(n)), str(max(0, i - 1))]) for i in range(n)}
    _, found = run(spark, parent)
    assert found == brute(parent)


def test_empty_null_repeated_and_foreign_columns(spark):
    nodes = spark.createDataFrame([("a", 1, 2), (None, 3, 4)], "key string, node int, root int")
    links = spark.createDataFrame([("a", None), (None, "a"), ("a", "zz")], "key string, parent_key string")
    assert [tuple(r) for r in H.hierarchy(nodes, links).collect()] == [("a", "a", 0)]
    nothing = spark.createDataFrame([], "key string"), spark.createDataFrame([], "key string, parent_key string")
    assert H.hierarchy(*nothing).count() == 0
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    links = spark.createDataFrame([("c", "b"), ("c", "a"), ("c", "b")], "key string, parent_key string")
    assert {r["key"]: r["root_key"] for r in H.hierarchy(nodes, links).collect()} == {"a": "a", "b": "b", "c": "a"}


SYM = "repo_id string, id string, name string, kind string, path string, parent_id string, indexed_at timestamp, removed_at timestamp, root string, depth int"


def test_symbol_parents_by_id_and_name(spark, rows):
    t = "2020-01-0{} 00:00:00"
    data = [
        ("r", "sym:1", "A", "class", "p", None, t.format(1), None, "x", 9),
        ("r", "sym:2", "m", "method", "p", "A", t.format(1), None, "x", 9),
        ("r", "sym:3", "n", "method", "p", "sym:2", t.format(2), None, "x", 9),
        ("r", "sym:3", "n", "method", "p", "sym:9", t.format(1), None, "x", 9),  # superseded
        ("r", "sym:4", "q", "method", "other", "A", t.format(1), None, "x", 9),  # no owner in that path
        ("r", "sym:5", "f", "function", "p", "m", t.format(1), None, "x", 9),  # a method owns nothing by name
        (None, "sym:6", None, None, None, "A", None, None, None, None),
        ("r", None, "z", "class", "p", "A", t.format(1), None, None, None),
        ("r", "sym:7", "e", "class", "p", "", t.format(1), None, None, None),
    ]
    d = spark.createDataFrame(data, SYM.replace("timestamp", "string")).withColumn("indexed_at", F.col("indexed_at").cast("timestamp")).withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    assert rows(H.symbol_roots(d)) == [("sym:2", "sym:1", 1), ("sym:3", "sym:1", 2), ("sym:4", "sym:4", 0), ("sym:5", "sym:5", 0), ("sym:6", "sym:6", 0), ("sym:7", "sym:7", 0)]
    tree = {r["symbol_id"]: (r["path"], r["n_descendants"]) for r in H.symbol_tree(d).collect()}
    assert tree["sym:1"] == ("A", 2) and tree["sym:3"] == ("A/m/n", 0)
    assert H.symbol_roots(d.where("false")).count() == 0


def test_rounds_are_bounded(spark):
    from codeloom.runtime import work_area

    with pytest.raises(RuntimeError):
        H.contract(work_area(spark, "t"), spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "node long, parent long"), max_rounds=1)


def sizes_by_hand(parent):
    n = dict.fromkeys(parent, 0)
    for k, (_, depth, path) in brute(parent).items():
        for a in (path or ())[:-1]:
            n[a] += 1
    return n


@pytest.mark.parametrize("seed", [3, 8])
def test_numbers_of_descendants_without_pairs(spark, seed):
    rnd = random.Random(seed)
    n = 160
    parent = {i: rnd.choice([None, rnd.randrange(n), max(0, i - 1), max(0, i - 1), max(0, i - 1)]) for i in range(n)}
    links = spark.createDataFrame([(k, p) for k, p in parent.items() if p is not None], "node long, parent long")
    got = {r["node"]: r["below"] for r in H.contract(H.work_area(spark, "t"), links, sizes=True).collect()}
    want, roots = sizes_by_hand(parent), brute(parent)
    assert all(got.get(k, 0) == (None if roots[k][1] < 0 else want[k]) for k in parent)


def test_a_very_deep_chain(spark):
    n = 100_000
    links = spark.range(n).selectExpr("id + 1 AS node", "id AS parent")
    d = H.contract(H.work_area(spark, "t"), links, sizes=True)
    r = d.agg(F.count("*"), F.max("depth"), F.count_if(F.col("depth") + F.col("below") != n), F.count_if(F.col("root") != 0)).first()
    assert tuple(r) == (n + 1, n, 0, 0)
