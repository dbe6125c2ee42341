"""What of an index is out of date, and what a run over it has to do; caches of results and loaded graphs."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph, load_graph
from codeloom.runtime import file_token

#: Share of changed files from which everything is indexed again.
FULL_SHARE = 0.5
OVERFLOW = ".overflow"
# What a watcher acts on.
RELEVANT = ["create", "write", "remove", "rename"]


def freshness(indexed: DataFrame, heads: DataFrame, edited: DataFrame, version: str) -> DataFrame:
    """indexed(repo_id, commit, version, indexed_at), heads(repo_id, head), edited(repo_id, edited_at, the newest change of a
    file) -> (repo_id, stale, reason), the first that holds: no index, head moved, other version, files changed since."""
    d = heads.select("repo_id", "head").join(indexed, "repo_id", "left").join(edited, "repo_id", "left")
    reason = (
        F.when(F.col("indexed_at").isNull(), "no index").when(F.col("commit") != F.col("head"), "head moved")
        .when(~F.col("version").eqNullSafe(F.lit(version)), "version changed").when(F.col("edited_at") > F.col("indexed_at"), "files changed")
    )
    return d.select("repo_id", reason.isNotNull().alias("stale"), reason.alias("reason"))


def newest_change(files: DataFrame, at: str) -> DataFrame:
    return files.groupBy("repo_id").agg(F.max(at).alias("edited_at"))


def index_plan(files: DataFrame, changed: DataFrame, share: float = FULL_SHARE) -> DataFrame:
    """files(repo_id, path), changed(repo_id, path) -> (repo_id, n_files, n_changed, mode): nothing, some files, or all."""
    n = files.select("repo_id", "path").distinct().groupBy("repo_id").agg(F.count("*").alias("n_files"))
    c = changed.select("repo_id", "path").distinct().groupBy("repo_id").agg(F.count("*").alias("n_changed"))
    d = n.join(c, "repo_id", "full").na.fill(0, ["n_files", "n_changed"])
    return d.withColumn("mode", F.when(F.col("n_changed") == 0, "none").when(F.col("n_changed") > share * F.col("n_files"), "full").otherwise("incremental"))


def stable_order(changed: DataFrame, files: DataFrame) -> DataFrame:
    """The changed files that exist, numbered in the order of a walk: (repo_id, path, place)."""
    d = files.select("repo_id", "path").distinct().join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("path")))


def intake(events: DataFrame, relevant: list[str] = RELEVANT, skip: str = r"(^|/)(\.git|node_modules|\.venv)/") -> DataFrame:
    """events(source, op, path) -> (source, path) that wait to be indexed, each once; other operations and skipped folders not."""
    d = events.where(F.col("op").isin(relevant) & F.col("path").isNotNull() & (F.col("path") != ""))
    return d.where(~F.col("path").rlike(skip)).select("source", "path").distinct()


def source_files(paths_: DataFrame, pattern: str, limit: int = 25) -> DataFrame:
    """paths(pos, path) -> the first ``limit``, in their order, that can be parsed."""
    return paths_.where(F.lower("path").rlike(pattern)).orderBy("pos").limit(limit)


def resync(batches: DataFrame, files: DataFrame) -> DataFrame:
    """batches(source, path): of a source whose watcher lost events (a path ``OVERFLOW``) every file, of others their paths."""
    lost = batches.where(F.col("path") == OVERFLOW).select("source").distinct()
    whole = files.select("source", "path").join(lost, "source", "left_semi")
    return batches.where(F.col("path") != OVERFLOW).join(lost, "source", "left_anti").select("source", "path").unionByName(whole).distinct()


def requeue(waiting: DataFrame, undelivered: DataFrame) -> DataFrame:
    """Paths that a receiver did not take wait again, beside those that came since; none is lost or doubled."""
    return waiting.select("source", "path").unionByName(undelivered.select("source", "path")).distinct()


class QueryCache:
    """Small results by query, for ``ttl`` seconds; of more than ``most`` the one used longest ago goes."""

    def __init__(self, ttl: float = 15.0, most: int = 256, clock=time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.kept: OrderedDict = OrderedDict()

    def get(self, key, make):
        """The rows kept for the key, or those of ``make()``, a DataFrame of bounded size."""
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < self.ttl:
            self.kept.move_to_end(key)
            return self.kept[key][1]
        rows = make().collect()
        self.kept[key] = (now, rows)
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return rows


_GRAPHS: dict[tuple, tuple] = {}


def cached_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph of a folder, kept by the session until a file of the folder changes."""
    key, token = (spark.sparkContext.applicationId, folder), file_token(spark, folder)
    if key in _GRAPHS and _GRAPHS[key][0] == token:
        return _GRAPHS[key][1]
    if key in _GRAPHS:
        old = _GRAPHS.pop(key)[1]
        for d in (old.files, old.symbols, old.edges):
            d.unpersist()
    g = load_graph(spark, folder)
    g = Graph(g.files.cache(), g.symbols.cache(), g.edges.cache())
    _GRAPHS[key] = (token, g)
    return g
