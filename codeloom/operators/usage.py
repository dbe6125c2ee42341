"""Reports over tool-call events, runs and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T


def tool_report(calls: DataFrame) -> DataFrame:
    """calls(tool, latency, failed) -> per tool: calls, errors, total and integer average latency, extremes."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("n_calls"), F.count_if("failed").alias("n_errors"), F.sum("latency").cast("bigint").alias("total_ms"),
        F.floor(F.sum("latency") / F.count("latency")).cast("bigint").alias("avg_ms"), F.min("latency").alias("min_ms"), F.max("latency").alias("max_ms"),
    )


def session_report(calls: DataFrame) -> DataFrame:
    """calls(session, ts, tool, latency, failed) -> per session: span, calls, errors, tools and the last tool called."""
    return calls.where("session IS NOT NULL AND session <> ''").groupBy("session").agg(
        F.count("*").alias("n_calls"), F.count_if("failed").alias("n_errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct("tool").alias("n_tools"), F.max(F.struct("ts", "tool")).getField("tool").alias("last_tool"), F.coalesce(F.sum("latency"), F.lit(0)).cast("bigint").alias("total_ms"),
    )


def run_traces(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Per run that exists: its calls in order of step, as text, with number and errors; bounded by the calls of a run."""
    order = F.array_sort(F.collect_list(F.struct("step_index", "called_at", "id", "tool_name")))
    known = calls.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")  # calls without a run could be any number
    c = known.groupBy("run_id").agg(F.array_join(F.transform(order, lambda x: x["tool_name"]), ">").alias("trace"), F.count("*").alias("n_steps"), F.count("error").alias("n_errors"))
    return runs.select(F.col("id").alias("run_id"), "status").join(c, "run_id").select("run_id", "status", "trace", "n_steps", "n_errors")


def search_memory(rows: DataFrame, query: str, latest: int = 200, k: int = 10) -> DataFrame:
    """rows(id, ts, text, weight) -> of the latest rows those with any of the query's tokens, by share of tokens and weight."""
    from codeloom.operators.search import tokens_of

    terms = [t for t in tokens_of(query) if len(t) >= 2]
    last = rows.orderBy(F.desc("ts"), "id").limit(latest)
    score = T.term_hits(F.coalesce("text", F.lit("")), F.array(*[F.lit(t) for t in terms])) / max(1, len(tokens_of(query))) if terms else F.lit(1.0)
    return last.select("id", F.round(score, 6).alias("score"), "weight").where("score > 0").orderBy(F.desc("score"), F.desc("weight"), "id").limit(k)


def sessions(events: DataFrame, gap_s: int, span_s: int = 86_400) -> DataFrame:
    """events(user, ts, id) -> (user, session, n, first_ts, last_ts), cut where nothing happens for longer than the gap.

    Events without a user or time are left out. Breaks are found within spans of time first, then between the spans of a
    user, so that a user with a third of all events is sorted span by span and only one row a span meets in one task.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.where("user IS NOT NULL AND ts IS NOT NULL").select("user", "ts", "id", us.alias("us"), F.floor(us / (span_s * 1_000_000)).alias("span"))
    w = Window.partitionBy("user", "span").orderBy("us", "id")
    e = e.withColumn("new", (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0)) > gap_s * 1_000_000).cast("bigint"))
    e = e.withColumn("local", F.sum("new").over(w))
    spans = e.groupBy("user", "span").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.max("local").alias("breaks"))
    u = Window.partitionBy("user").orderBy("span")
    spans = spans.withColumn("gap", F.coalesce((F.col("a") - F.lag("b").over(u)) > gap_s * 1_000_000, F.lit(True)).cast("bigint"))
    spans = spans.withColumn("base", F.sum("gap").over(u) + F.coalesce(F.sum("breaks").over(u.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = e.join(spans.select("user", "span", "base"), ["user", "span"])
    return d.groupBy("user", (F.col("base") + F.col("local")).alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
