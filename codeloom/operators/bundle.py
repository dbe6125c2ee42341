"""Bounded context of symbols: callers, callees, imports, tests and source of many symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.graph import REFERENCES, Graph

# Folders that no context is packed from.
PACK_EXCLUDE = ["node_modules", "vendor", "dist", "build", "target", ".git", ".venv", "venv", "__pycache__", "coverage", ".next", "generated", "__generated__"]
UPDATE_KINDS = ["function", "method", "class", "variable"]


def first_of(pairs: DataFrame, key: str, value: str, limit: int, name: str) -> DataFrame:
    """The first ``limit`` values of each key in order, as an array; the rank filter is applied before the shuffle too."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(value))
    d = pairs.select(key, value).distinct().withColumn("r", r).where(F.col("r") <= limit)
    return d.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def context_bundles(g: Graph, callers: int = 24, callees: int = 24, imports: int = 24, tests: int = 6, is_test: Column | None = None) -> DataFrame:
    """(id, callers, callees, imports, tests) of every symbol, each list cut to its limit and empty where there is none."""
    known = g.symbols.select("id", "name", "path", "repo_id")
    e = g.edges.where(F.col("kind").isin(REFERENCES)).select("src_id", "dst_id", "kind").join(known.select(F.col("id").alias("src_id"), F.col("path").alias("src_path"), F.col("name").alias("src_name")), "src_id")
    test = paths.path_flag("test", F.col("src_path")) if is_test is None else is_test
    into = e.select(F.col("dst_id").alias("id"), F.col("src_id").alias("other"), test.alias("test"))
    out = g.edges.where("kind = 'calls'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("other")).join(known.select(F.col("id").alias("other")), "other", "left_semi")
    of_file = g.edges.where("kind = 'imports'").select(F.col("src_id").alias("file_id"), F.col("dst_id").alias("other"))
    d = known.select("id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("file_id"))
    d = d.join(first_of(into, "id", "other", callers, "callers"), "id", "left").join(first_of(out, "id", "other", callees, "callees"), "id", "left")
    d = d.join(first_of(into.where("test"), "id", "other", tests, "tests"), "id", "left").join(first_of(of_file, "file_id", "other", imports, "imports"), "file_id", "left")
    return d.select("id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("callers", "callees", "imports", "tests")])


def source_slices(symbols: DataFrame, texts: DataFrame, lines: int = 40) -> DataFrame:
    """texts(file_id, text) -> (id, source, n_shown): the lines of each symbol, at most ``lines``, as far as the text has them.

    A missing or bad last line means the end of the text; symbols that start behind it have no row.
    """
    t = texts.where("text IS NOT NULL").select("file_id", F.split("text", r"\r\n|\n|\r").alias("all"))
    s = symbols.select("id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("file_id"), F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)).alias("a"), F.coalesce("line_end", F.lit(0)).alias("b"))
    d = s.join(t, "file_id").where(F.col("a") <= F.size("all"))
    end = F.when((F.col("b") <= 0) | (F.col("b") > F.size("all")), F.size("all")).otherwise(F.greatest("a", "b"))
    n = F.least(end - F.col("a") + 1, F.lit(lines))
    return d.select("id", F.array_join(F.slice("all", F.col("a"), n), "\n").alias("source"), n.cast("bigint").alias("n_shown"))


def dependency_neighbors(g: Graph, hits: DataFrame, seeds: int = 4, limit: int = 12) -> DataFrame:
    """hits(query_id, id, score, rank) -> what fills a context behind them: symbols one call away from the best ``seeds``
    hits, with nine tenths of the score of the best seed they hang from; no hits themselves, ``limit`` a query."""
    s = hits.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("seed"), "score", "rank")
    calls = g.edges.where("kind = 'calls'").select("src_id", "dst_id")
    near = s.join(calls, F.col("seed") == F.col("src_id")).select("query_id", "rank", "score", F.col("dst_id").alias("id")).unionByName(s.join(calls, F.col("seed") == F.col("dst_id")).select("query_id", "rank", "score", F.col("src_id").alias("id")))
    near = near.join(g.symbols.select("id"), "id", "left_semi").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    best = near.groupBy("query_id", "id").agg(F.min(F.struct("rank", "score")).alias("b")).select("query_id", "id", F.col("b.rank").alias("seed_rank"), F.round(F.col("b.score") * 0.9, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seed_rank", "id"))
    return best.withColumn("place", place).where(F.col("place") <= limit)


def must_update(reached: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """reached(seed, node, depth) -> (seed, node, place): the first direct dependants by path and id that hold code."""
    d = reached.where("depth = 1").join(symbols.where(F.col("kind").isin(UPDATE_KINDS)).select(F.col("id").alias("node"), "path"), "node")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("path", "node"))
    return d.withColumn("place", place).where(F.col("place") <= limit).select("seed", "node", "place")


def packable(path: Column) -> Column:
    """Whether no folder of a path is one that contexts leave out."""
    return ~F.arrays_overlap(F.split(F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")), "/"), F.array(*[F.lit(x) for x in PACK_EXCLUDE]))


def path_matches(path: Column, wanted: str) -> Column:
    return F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit(wanted.lower()))


def bench_targets(symbols: DataFrame, least: int = 6, limit: int | None = 40) -> DataFrame:
    """(repo_id, name): function and method names of ``least`` characters or more, unique in their repository; the first
    ``limit`` of each by name, all of them without a limit."""
    n = symbols.where("kind IN ('function', 'method')").where(F.length("name") >= least).groupBy("repo_id", "name").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    if limit is None:
        return n
    return n.withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("name"))).where(F.col("r") <= limit).drop("r")


def golden_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """hits(query_id, path, rank), cases(query_id, needle), all needles of a case wanted -> (query_id, passed, first_rank,
    n_missing): whether each needle is in some hit's path, and the rank of the first hit with any (0: none)."""
    h = hits.withColumn("place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("rank")))
    m = cases.join(h, "query_id", "left").withColumn("hit", F.contains(F.lower("path"), F.lower("needle")))
    by = m.groupBy("query_id", "needle").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return by.groupBy("query_id").agg((F.count_if(F.col("first").isNull()) == 0).alias("passed"), F.coalesce(F.min("first"), F.lit(0)).alias("first_rank"), F.count_if(F.col("first").isNull()).alias("n_missing"))
