"""A run of the index: what changed is extracted again and replaces what the tables hold of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import freshness
from codeloom.operators.graph import Graph
from codeloom.operators.stores import KeyedTable
from codeloom.runtime import work_area
from codeloom.sources import extract
from codeloom.streaming import incremental

SYMBOLS = "repo_id string, path string, id string, kind string, name string, line_start int, line_end int, language string, signature string, parent_id string"
EDGES = "repo_id string, path string, id string, kind string, src_id string, dst_id string, confidence double"


def tables(spark: SparkSession, folder: str, buckets: int = 32) -> tuple[KeyedTable, KeyedTable, KeyedTable]:
    """Files, symbols and edges of an index; what is extracted from a file is one group."""
    group = ["repo_id", "path"]
    return KeyedTable(spark, f"{folder}/files", group, buckets=buckets), KeyedTable(spark, f"{folder}/symbols", [*group, "id"], group, buckets), KeyedTable(spark, f"{folder}/edges", [*group, "id"], group, buckets)


def index_run(spark: SparkSession, now: DataFrame, folder: str, share: float = freshness.FULL_SHARE, buckets: int = 32) -> DataFrame:
    """now(repo_id, path, language, content), all files that exist -> (repo_id, n_files, n_changed, mode) of the run.

    Files whose content's hash is not that of the index, and all files of repositories of which more than ``share``
    changed, are extracted again; those that are gone lose their rows. A run that failed half-way is given again: the
    hashes are written last.
    """
    area = work_area(spark, "index")
    files, symbols, edges = tables(spark, folder, buckets)
    now = now.where("repo_id IS NOT NULL AND path IS NOT NULL").dropDuplicates(["repo_id", "path"]).withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    now = area.put(now.select("repo_id", "path", "language", "content", "hash"), "now")
    before = files.read()
    before = before.select("repo_id", "path", "hash") if before is not None else spark.createDataFrame([], "repo_id string, path string, hash string")
    changed = area.put(incremental.changed_files(now, before), "changed")
    plan = area.put(freshness.index_plan(now, changed, share), "plan")
    whole = now.join(plan.where("mode = 'full'"), "repo_id", "left_semi").select("repo_id", "path")
    groups = area.put(changed.select("repo_id", "path").unionByName(whole).distinct(), "groups")
    if not groups.isEmpty():
        todo = now.join(groups, ["repo_id", "path"], "left_semi")
        rows = area.put(extract.extract(todo), "rows")
        s = rows.where("row = 'symbol'").join(todo.select("repo_id", "path", "language"), ["repo_id", "path"]).selectExpr(*[c.split()[0] for c in SYMBOLS.split(", ")])
        e = rows.where("row = 'edge'").selectExpr(*[c.split()[0] for c in EDGES.split(", ")]).dropDuplicates(["repo_id", "path", "id"])
        symbols.replace(s.dropDuplicates(["repo_id", "path", "id"]), groups)
        edges.replace(e, groups)
        gone = changed.where("change = 'deleted'").select("repo_id", "path")
        files.delete(gone)
        files.upsert(todo.select("repo_id", "path", "language", "hash"))
    return plan


def index_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph that the tables hold."""
    files, symbols, edges = (t.read() for t in tables(spark, folder))
    if files is None:
        empty = lambda s: spark.createDataFrame([], s)
        return Graph(empty("repo_id string, id string, path string, language string, hash string"), empty(SYMBOLS), empty(EDGES).drop("path"))
    f = files.select("repo_id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("id"), "path", "language", "hash")
    return Graph(f, symbols, edges.drop("path").dropDuplicates(["id"]))


def watch(events: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, relevant: list[str] = freshness.RELEVANT, skip: str = r"(^|/)(\.git|node_modules|\.venv)/"):
    """Stream of events(source, ts, op, path): relevant ones are debounced, and ``run(batch, number)`` gets the batches
    (source, first_ms, last_ms, paths, reason). A batch whose run fails comes again from the checkpoint, none is lost."""
    wanted = events.where(F.col("op").isin(relevant) & F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").rlike(skip))
    return incremental.debounced(wanted.select("source", "ts", "path")).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
