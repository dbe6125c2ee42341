"""Streams: debounced batches of changed paths and incremental graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds: quiet time that ends a batch, shorter while few paths wait, longest wait; most paths of a batch.
QUIET, QUIET_FEW, FEW, LONGEST, MOST = 350, 90, 2, 3000, 512

OUT = "source string, first_ms long, last_ms long, paths array<string>, reason string"
STATE = "paths array<string>, first_ms long, last_ms long"


def debounce_batches(events, quiet: int = QUIET, quiet_few: int = QUIET_FEW, few: int = FEW, longest: int = LONGEST, most: int = MOST):
    """Batches of (ms, path) in order of time: (first_ms, last_ms, sorted distinct paths, reason), and what still waits.

    A batch ends when nothing comes for the quiet time (the shorter one while few paths wait), when its first path has
    waited longest, or when it is full. No path is dropped.
    """
    out, paths, first, last = [], set(), None, None

    def flush(reason):
        nonlocal paths, first, last
        out.append((first, last, sorted(paths), reason))
        paths, first, last = set(), None, None

    for ms, path in events:
        if paths:
            wait = quiet_few if len(paths) <= few else quiet
            if ms >= min(last + wait, first + longest):
                flush("max_wait" if first + longest <= last + wait else "debounce")
        if first is None:
            first = ms
        paths.add(path)
        last = ms
        if len(paths) >= most:
            flush("full")
    return out, (sorted(paths), first, last)


def debounced(changes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Stream of changes(source, ts, path) -> batches per source. Rows up to ``delay`` late are in order; state is one batch."""

    def step(key, tables, state: GroupState):
        import pandas as pd

        paths, first, last = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], None, None)
        if state.hasTimedOut:
            state.remove()
            if paths:
                yield pd.DataFrame([(key[0], first, last, sorted(set(paths)), "debounce")], columns=["source", "first_ms", "last_ms", "paths", "reason"])
            return
        events = []
        for t in tables:
            events += list(zip((t["ts"].astype("int64") // 1_000_000 if t["ts"].dtype == "datetime64[ns]" else t["ts"].astype("datetime64[ms]").astype("int64")).tolist(), t["path"].tolist()))
        events.sort()
        # the waiting batch goes on: its paths count from its first to its last time
        held = [(first, p) for p in paths[:-1]] + [(last, paths[-1])] if paths else []
        done, (paths, first, last) = debounce_batches(held + events)
        if paths:
            state.update((paths, first, last))
            state.setTimeoutTimestamp(max(last + QUIET, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(key[0], *b) for b in done], columns=["source", "first_ms", "last_ms", "paths", "reason"])

    return changes.withWatermark("ts", delay).groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_batches(changes: DataFrame, gap: str = "350 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The simpler form in built-in operators: paths per source between gaps, without longest wait and size limit."""
    d = changes.withWatermark("ts", delay).groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return d.select("source", "w.start", "w.end", "paths")


def upsert_stream(updates: DataFrame, folder: str, keys: list[str], at: str, checkpoint: str, buckets: int = 32):
    """Stream of rows into a table of current rows at ``folder``: each micro-batch is merged, last write wins, and only the
    buckets of its keys are rewritten. A batch that is repeated after a failure finds its number in the table and is left out."""
    from codeloom.operators.stores import KeyedTable

    def merge(batch: DataFrame, n: int):
        table = KeyedTable(batch.sparkSession, folder, keys, buckets=buckets)
        if n > table.batch:
            table.upsert(batch, at, n)
            table.vacuum()

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_table(spark, folder: str, keys: list[str]) -> DataFrame | None:
    """Rows of the newest version of a table of current rows; None where there is none yet."""
    from codeloom.operators.stores import KeyedTable

    return KeyedTable(spark, folder, keys).read()


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(repo_id, path, change): added, changed or deleted by content hash; a null hash never counts as unchanged."""
    a = now.select("repo_id", "path", F.col("hash").alias("h1"), F.lit(1).alias("in1"))
    b = before.select("repo_id", "path", F.col("hash").alias("h0"), F.lit(1).alias("in0"))
    d = a.join(b, ["repo_id", "path"], "full")
    kind = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "deleted").when(F.coalesce(F.col("h0") == F.col("h1"), F.lit(False)), None).otherwise("changed")
    return d.select("repo_id", "path", kind.alias("change")).where("change IS NOT NULL")
