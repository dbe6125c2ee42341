"""Exact percentiles of large numeric columns per group, by bisection of value intervals.

Partitions and days are first reduced to value counts (group, value, n), which simply add up when combined. Then every
(group, percentile) keeps an interval that holds its value; each pass counts the rows below the midpoints that cut all
intervals into ``FAN`` parts and keeps the part with the wanted rank, until intervals are single values (or narrower
than the tolerance). A pass is one combined aggregation; nothing is sorted and no group is gathered in a task: the value
counts of a large group lie in shards of bounded size, each of which gets the group's few intervals. Whether intervals
are sent to all tasks or joined by a shuffle follows from their size at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.runtime import WorkArea

FAN = 16
#: Value counts of a group that lie in one shard; the intervals of larger groups go to each of their shards.
ROWS_A_SHARD = 500_000


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n); null values are no measurements. Integral values only."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("bigint").alias("value")).agg(F.count("*").alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Value counts of separate partitions or days as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    by = [c for c in whole.columns if c not in ("value", "n")]
    return whole.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, by: list[str], ps: list[int], area: WorkArea, tolerance: int = 0) -> DataFrame:
    """counts(by..., value, n) -> (by..., p, n, value): the sorted value at index floor(p/100*(n-1)) of each group.

    With a tolerance, ``value`` is the upper end of an interval at most that much wider than exact. Groups are compared
    null-safely; a group has a row for each p if it has any value.
    """
    data = area.put(counts.select(*by, "value", "n"), "values")
    groups = area.put(data.groupBy(*by).agg(F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.ceil(F.count("*") / ROWS_A_SHARD).cast("int").alias("shards")), "groups")
    heavy = groups.where("shards > 1").select(*[F.col(c).alias(f"g_{c}") for c in by], "shards")
    split = not heavy.isEmpty()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    if split:
        salted = data.join(heavy, same, "left").withColumn("shard", F.pmod(F.xxhash64("value"), F.coalesce("shards", F.lit(1))).cast("int"))
        data = area.put(salted.select(*by, "value", "n", "shard"), "sharded")
    exact_at = F.expr("(total - 1) * p div 100")
    spans = groups.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps]))).withColumn("rank", exact_at).withColumn("below", F.lit(0).cast("bigint"))
    spans = area.put(spans.select(*by, "p", "total", "rank", "below", "lo", "hi"), "spans0")
    done: list[str] = []
    turn = 0
    while True:
        is_done = F.col("hi") - F.col("lo") <= tolerance
        area.put(spans.where(is_done), f"done{turn}")
        done.append(area.path(f"done{turn}"))
        open_spans = spans.where(~is_done)
        if open_spans.isEmpty():
            break
        turn += 1
        s = open_spans.select(*[F.col(c).alias(f"g_{c}") for c in by], "p", "total", "rank", "below", "lo", "hi")
        step = F.expr(f"(hi - lo) div {FAN} + 1")
        s = s.withColumn("step", step)
        on = same
        if split:
            of = groups.select(*[F.col(c).alias(f"h_{c}") for c in by], "shards")
            mine = F.lit(True)
            for c in by:
                mine = mine & F.col(f"g_{c}").eqNullSafe(F.col(f"h_{c}"))
            s = s.join(of, mine).withColumn("s_shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
            on = same & (F.col("shard") == F.col("s_shard"))
        hit = data.join(s, on & F.col("value").between(F.col("lo"), F.col("hi")))
        hit = hit.withColumn("part", F.expr("(value - lo) div step"))
        keys = [*[F.col(f"g_{c}").alias(c) for c in by], *[F.col(c) for c in ("p", "total", "rank", "below", "lo", "hi", "step", "part")]]
        parts = hit.groupBy(*keys).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "p").orderBy("part")
        cum = F.sum("n").over(w)
        parts = parts.withColumn("upto", F.col("below") + cum).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        lo = F.col("lo") + F.col("part") * F.col("step")
        spans = parts.select(*by, "p", "total", "rank", (F.col("upto") - F.col("n")).alias("below"), lo.alias("lo"), F.least("hi", lo + F.col("step") - 1).alias("hi"))
        spans = area.put(spans, f"spans{turn}")
        area.drop(f"spans{turn - 1}")
    found = area.spark.read.parquet(*done)
    return found.select(*by, "p", F.col("total").alias("n"), F.col("hi").alias("value"))


def tool_durations(calls: DataFrame) -> DataFrame:
    """(tool_name, week, duration_ms) of each current call with a measurement."""
    from codeloom.operators.current import latest

    cur = latest(calls, ["id"], "logged_at", ["tool_name", "called_at", "duration_ms"]).where("duration_ms >= 0")
    week = F.date_format(F.date_trunc("week", F.col("called_at").cast("timestamp")), "yyyy-MM-dd")
    return cur.select(F.lower(F.trim("tool_name")).alias("tool_name"), week.alias("week"), "duration_ms")
