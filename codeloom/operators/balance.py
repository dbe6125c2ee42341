"""Per-key results without the imbalance of hot keys: fragment-replicate by estimated load.

A counting pass (combined map-side) gives each key's load. A key heavier than a share of one task is split into shards
in proportion; all lighter keys are hashed into slots. Shards and slots are packed onto tasks, largest first, on the
driver: at most ``tasks / HEAVY`` keys can be heavy and the slots are a fixed number a task, so what the driver and the
broadcast routing table hold is bounded by the number of tasks, not by the data. The matching side of a join is
replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy above this share of a task's fair load; slots for light keys a task.
HEAVY, SLOTS = 0.25, 16


@dataclass
class LoadPlan:
    tasks: int
    total: int
    heavy: dict  # key -> tasks of its shards
    slots: list  # slot -> task

    def routing(self, spark) -> tuple[DataFrame, DataFrame]:
        h = spark.createDataFrame([(k, t) for k, t in self.heavy.items()], "bal_key string, bal_tasks array<int>")
        s = spark.createDataFrame(list(enumerate(self.slots)), "bal_slot int, bal_task int")
        return F.broadcast(h), F.broadcast(s)

    def loads(self, weights: dict, slot_load: list) -> list[float]:
        out = [0.0] * self.tasks
        for k, tasks in self.heavy.items():
            for t in tasks:
                out[t] += weights[k] / len(tasks)
        for s, t in enumerate(self.slots):
            out[t] += slot_load[s]
        return out


def pack(heavy: dict, slot_load: list, tasks: int) -> LoadPlan:
    """Largest-first packing of key shards and slots onto tasks; each load goes to the task with the least so far."""
    total = sum(heavy.values()) + sum(slot_load)
    fair = max(1.0, total / tasks)
    pieces = []
    for k, n in heavy.items():
        shards = min(tasks, max(1, math.ceil(n / (fair * HEAVY))))
        pieces += [(n / shards, 0, k)] * shards
    pieces += [(n, 1, s) for s, n in enumerate(slot_load)]
    pieces.sort(key=lambda p: (-p[0], p[1], str(p[2])))
    heap = [(0.0, t) for t in range(tasks)]
    routes: dict = {k: [] for k in heavy}
    slots = [0] * len(slot_load)
    for load, kind, name in pieces:
        at, t = heapq.heappop(heap)
        if kind == 0:
            routes[name].append(t)
        else:
            slots[name] = t
        heapq.heappush(heap, (at + load, t))
    return LoadPlan(tasks, int(total), routes, slots)


def _slot(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(n)).cast("int")


def plan_load(df: DataFrame, key: Column, tasks: int | None = None) -> LoadPlan:
    """Count the rows of each key and pack them. ``tasks`` defaults to the session's shuffle partitions."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_slots = SLOTS * tasks
    least = max(1, math.ceil(df.count() / tasks * HEAVY))
    loads = df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).withColumn("slot", _slot(F.col("k"), n_slots))
    big = F.when((F.col("n") >= least) & F.col("k").isNotNull(), F.struct("k", "n"))
    rows = loads.groupBy("slot").agg(F.sum("n").alias("n"), F.collect_list(big).alias("big")).collect()  # n_slots rows, at most tasks / HEAVY keys in all
    heavy: dict = {}
    slot_load = [0] * n_slots
    for r in rows:
        slot_load[r["slot"]] = r["n"] - sum(x["n"] for x in r["big"])
        heavy |= {x["k"]: x["n"] for x in r["big"]}
    return pack(heavy, slot_load, tasks)


def route(df: DataFrame, key: Column, by: Column, plan: LoadPlan) -> DataFrame:
    """df with ``bal_task``, moved to that task; equal (key, by) values meet in one task."""
    heavy, slots = plan.routing(df.sparkSession)
    d = df.withColumns({"bal_key": key, "bal_slot": _slot(key, len(plan.slots))})
    d = d.join(heavy, "bal_key", "left").join(slots, "bal_slot", "left")
    shard = F.get("bal_tasks", F.pmod(F.xxhash64(by), F.size("bal_tasks")).cast("int"))
    d = d.withColumn("bal_task", F.coalesce(shard, F.col("bal_task"))).drop("bal_slot", "bal_tasks")
    return d.repartitionById(plan.tasks, F.col("bal_task"))


def replicate(df: DataFrame, key: Column, plan: LoadPlan) -> DataFrame:
    """The matching side: a copy of each row for every task that holds a shard of its key, else for its slot's task."""
    heavy, slots = plan.routing(df.sparkSession)
    d = df.withColumns({"bal_key": key, "bal_slot": _slot(key, len(plan.slots))})
    d = d.join(heavy, "bal_key", "left").join(slots, "bal_slot", "left")
    to = F.coalesce(F.col("bal_tasks"), F.array("bal_task"))
    d = d.withColumn("bal_at", F.explode(F.array_distinct(to))).drop("bal_slot", "bal_tasks", "bal_task").withColumnRenamed("bal_at", "bal_task")
    return d.repartitionById(plan.tasks, F.col("bal_task"))


def distinct_counts(df: DataFrame, keys: list[str], item: str, tasks: int | None = None) -> DataFrame:
    """(key_field, key_item, n): the distinct ``item`` values of each value of each key column.

    Rows go to tasks by load, a hot key's rows by item, so each task counts its own items and the counts of a key's
    shards add up. A null key counts under key_item null; a null item counts as nothing. An empty table gives no row.
    """
    fields = F.array(*[F.struct(F.lit(i).alias("f"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])
    long = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(fields).alias("x"))
    tag = F.concat(F.col("x.f").cast("string"), F.when(F.col("x.v").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("x.v"))))
    plan = plan_load(df.where(F.col(item).isNotNull()).select(F.explode(fields).alias("x")), tag, tasks)
    hi, lo = F.xxhash64(F.lit("a"), F.col("item")), F.xxhash64(F.lit("b"), F.reverse(F.col("item")), F.col("item"))
    moved = route(long.select(tag.alias("tag"), hi.alias("hi"), lo.alias("lo")), F.col("tag"), F.col("hi"), plan)
    each = moved.groupBy("bal_task", "tag", "hi", "lo").agg(F.lit(1).alias("one"))
    part = each.groupBy("bal_task", "tag").agg(F.count("*").alias("n"))
    whole = part.groupBy("tag").agg(F.sum("n").alias("n"))
    digits = r"^(\d+)"
    field = F.get(F.array(*[F.lit(k) for k in keys]), F.regexp_extract("tag", digits, 1).cast("int"))
    rest = F.regexp_replace("tag", digits, "")
    return whole.select(field.alias("key_field"), F.when(rest.startswith("+"), F.substr(rest, F.lit(2))).alias("key_item"), F.col("n").cast("bigint").alias("n"))


def heavy_keys(df: DataFrame, keys: list[str], item: str, share: float = 0.01, tasks: int | None = None) -> DataFrame:
    """(key_field, key_item) of each key value that holds at least ``share`` of the distinct items."""
    from codeloom.runtime import work_area

    area = work_area(df.sparkSession, "balance")
    n = area.put(distinct_counts(df, keys, item, tasks), "counts")
    total = n.groupBy("key_field").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "key_field").where(F.col("key_item").isNotNull() & (F.col("n") >= F.col("total") * share)).select("key_field", "key_item")


def profile(edges: DataFrame, nodes: DataFrame, key: str = "dst_id", item: str = "id", other: str = "src_id", tasks: int | None = None) -> DataFrame:
    """Per key: (key_item, edges, sources, target_name) with distinct edge ids, distinct sources and the name in ``nodes``
    (id, name), joined where the key's shards are."""
    hi, lo = F.xxhash64(F.lit("a"), F.col(item)), F.xxhash64(F.lit("b"), F.reverse(F.col(item)), F.col(item))
    base = edges.where(F.col(item).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), hi.alias("hi"), lo.alias("lo"), F.xxhash64(F.col(other)).alias("src"), F.xxhash64(F.lit("b"), F.reverse(F.col(other))).alias("src2"))
    plan = plan_load(base.select("key"), F.col("key"), tasks)
    rows = route(base, F.col("key"), F.col("src"), plan)
    once = rows.groupBy("bal_task", "key", "src", "src2", "hi", "lo").agg(F.lit(1).alias("one"))
    each = once.groupBy("bal_task", "key", "src", "src2").agg(F.count("*").alias("n"))
    each = each.groupBy("bal_task", "key").agg(F.sum("n").alias("edges"), F.count("*").alias("sources"))
    names = nodes.groupBy("id").agg(F.min("name").alias("name"))
    side = replicate(names.select(F.col("id").alias("key"), "name"), F.col("key"), plan).drop("bal_key")
    joined = each.join(side, ["bal_task", "key"], "left")
    return joined.groupBy(F.col("key").alias("key_item")).agg(F.sum("edges").cast("bigint").alias("edges"), F.sum("sources").cast("bigint").alias("sources"), F.max("name").alias("target_name"))
