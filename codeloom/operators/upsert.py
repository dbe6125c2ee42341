"""Idempotent changes of graph tables as immutable snapshots: anti-join, union, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.current import latest
from codeloom.operators.graph import Graph


def merge_last(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of several new ones the latest counts."""
    fresh = latest(new, keys, at).select(*new.columns)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def merge_greatest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key with its greatest value and the number of rows; null only where all are null."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value), F.count("*").alias("n_rows"))


def remove_paths(g: Graph, gone: DataFrame) -> Graph:
    """gone(repo_id, path): their symbols and every edge that touches one of these."""
    ids = g.symbols.join(gone, ["repo_id", "path"], "left_semi").select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return Graph(g.files, g.symbols.join(gone, ["repo_id", "path"], "left_anti"), edges)


def clear_repos(g: Graph, repos: DataFrame) -> Graph:
    drop = lambda d: d.join(repos, "repo_id", "left_anti")
    return Graph(drop(g.files), drop(g.symbols), drop(g.edges))


def rename_symbol(symbols: DataFrame, symbol_id: str, name: str) -> DataFrame:
    """Only the name changes; edges keep pointing at the id."""
    return symbols.withColumn("name", F.when(F.col("id") == symbol_id, F.lit(name)).otherwise(F.col("name")))


def write_graph(g: Graph, folder: str) -> None:
    """Files and symbols partitioned by repository, edges twice: sorted by either end for walks in both directions."""
    for name, d in (("files", g.files), ("symbols", g.symbols)):
        d.write.mode("overwrite").partitionBy("repo_id").parquet(f"{folder}/{name}")
    for end in ("src_id", "dst_id"):
        g.edges.repartitionByRange(end).sortWithinPartitions(end).write.mode("overwrite").parquet(f"{folder}/edges_by_{end[:3]}")


def read_graph(spark, folder: str, by: str = "src") -> Graph:
    r = lambda n: spark.read.parquet(f"{folder}/{n}")
    return Graph(r("files"), r("symbols"), r(f"edges_by_{by}"))


def write_merged(g: Graph, path: str) -> None:
    """The counts over all repositories and of each one as JSON lines."""
    from codeloom.operators.graph import graph_counts, merge_snapshots

    whole = merge_snapshots(g).select(F.lit(None).cast("string").alias("repo_id"), "n_files", "n_symbols", "n_edges")
    whole.unionByName(graph_counts(g)).write.mode("overwrite").json(path)
