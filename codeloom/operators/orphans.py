"""References to records that are missing, deleted or arrive later: a range-partitioned index of sorted parent keys,
probed by binary search with batches of references.

Parents are keyed by 128 bits of their id; the leading bits are uniform, so equal ranges of them hold equally many
parents and need no sampling. A range's parents are stored once as sorted arrays; references go to the range of their
target, in as many shards as bound their number, each with a copy of the arrays; a range with a hot target has more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.current import key128, latest
from codeloom.runtime import WorkArea, work_area

PARENTS_A_RANGE, REFS_A_SHARD = 10_000, 15_000
#: Ranges with many more references than the others are sent to the tasks up to so many (16 bytes each); beyond that the
#: references are spread over so many salts before they meet the table of these ranges.
HOT_RANGES, SALTS = 1_000_000, 64

MISSING, DELETED, LATE = 1, 2, 3
REASONS = {MISSING: "missing", DELETED: "deleted", LATE: "late"}


def _range(hi: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hi, 64 - bits) if bits else F.lit(0).cast("bigint")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def range_index(parents: DataFrame, bits: int) -> DataFrame:
    """parents(space, id, first, gone) with one row per id -> (range, hi[], lo[], first[], gone[]) sorted by (hi, lo)."""
    hi, lo = key128(F.col("space"), F.col("id"))
    p = parents.select(hi.alias("hi"), lo.alias("lo"), _micros(F.col("first")).alias("first"), F.col("gone"))
    rows = p.groupBy(_range(F.col("hi"), bits).alias("range")).agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "first", "gone"))).alias("x"))
    return rows.select("range", *[F.col(f"x.{c}").alias(c) for c in ("hi", "lo", "first", "gone")])


def _probe(key, parents, refs):
    import numpy as np
    import pyarrow as pa

    n = refs.num_rows
    reason = np.full(n, MISSING, dtype="int32")
    if parents.num_rows and n:
        flat = lambda c: parents.column(c).combine_chunks().flatten()
        hi, lo = flat("hi").to_numpy(), flat("lo").to_numpy()
        first = flat("first")
        none = first.is_null().to_numpy(zero_copy_only=False)
        first = first.fill_null(0).to_numpy()
        gone = flat("gone").to_numpy(zero_copy_only=False)
        want_hi, want_lo = refs.column("hi").to_numpy(), refs.column("lo").to_numpy()
        at = np.minimum(np.searchsorted(hi, want_hi), len(hi) - 1)
        while True:  # step over different keys that share the first half
            on = (hi[at] == want_hi) & (lo[at] < want_lo) & (at + 1 < len(hi))
            if not on.any():
                break
            at = at + on
        there = (hi[at] == want_hi) & (lo[at] == want_lo)
        when = refs.column("ref_at")
        timed = ~when.is_null().to_numpy(zero_copy_only=False) if isinstance(when, pa.Array) else ~np.asarray(when.is_null())
        late = there & timed & ~none[at] & (first[at] > when.fill_null(0).to_numpy())
        reason[there] = 0
        reason[late] = LATE
        reason[there & gone[at]] = DELETED
    bad = np.flatnonzero(reason)
    kept = refs.select(["ref_kind", "row_id", "ref_at"]).take(pa.array(bad))
    return kept.append_column("reason", pa.array(reason[bad], pa.int32()))


def orphans(parents: DataFrame, refs: DataFrame, area: WorkArea, n_parents: int, loads: DataFrame | None = None) -> DataFrame:
    """parents(space, id, first TIMESTAMP, gone BOOLEAN), one row per id; refs(ref_kind INT, row_id STRING, space, id, ref_at
    TIMESTAMP) -> (ref_kind, row_id, ref_at BIGINT micros, reason INT) of the references that miss, in full.

    A reference is missing where its id is no parent's, else deleted where the parent is gone, else late where the
    parent's first time lies after the reference's; unknown times are never late. Null ids are no references.
    ``n_parents`` (an upper bound will do) sets the number of ranges; ``loads(space, id)`` may give a cheaper table to
    count the references of each range from, by default ``refs`` itself.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_parents) / PARENTS_A_RANGE))) if n_parents > PARENTS_A_RANGE else 0
    index = area.put(range_index(parents.where("id IS NOT NULL"), bits), "index")
    hi, lo = key128(F.col("space"), F.col("id"))
    probes = refs.where("id IS NOT NULL").select(F.col("ref_kind"), F.col("row_id"), _micros(F.col("ref_at")).alias("ref_at"), hi.alias("hi"), lo.alias("lo")).withColumn("range", _range(F.col("hi"), bits))
    counted = (loads if loads is not None else refs).where("id IS NOT NULL").select(_range(key128(F.col("space"), F.col("id"))[0], bits).alias("range"))
    load = area.put(counted.groupBy("range").agg(F.count("*").alias("n")), "load")
    # keys are uniform, so most ranges have about the same number of references and of shards; those with twice as many are told apart
    usual = max(1, math.ceil((load.agg(F.sum("n")).first()[0] or 0) / (1 << bits) / REFS_A_SHARD))
    hot = load.where(F.col("n") > 2 * usual * REFS_A_SHARD).select("range", F.ceil(F.col("n") / REFS_A_SHARD).cast("int").alias("shards"))
    shards = F.coalesce("shards", F.lit(usual))
    left = index.join(hot, "range", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1))).drop("shards")
    if hot.count() <= HOT_RANGES:
        right = probes.join(F.broadcast(hot), "range", "left")
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        right = probes.withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_kind"), F.lit(SALTS)).cast("int")).join(salted, ["range", "salt"], "left").drop("salt")
    right = right.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "row_id", "ref_kind"), shards).cast("int")).drop("shards")
    return left.groupBy("range", "shard").cogroup(right.groupBy("range", "shard")).applyInArrow(_probe, "ref_kind int, row_id string, ref_at long, reason int")


def code_orphans(edges: DataFrame, calls: DataFrame, symbols: DataFrame, sdk_symbols: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Orphan references of edges (both ends) and tool calls (their run): (source_table, ref_field, row_id, reason, ref_month)."""
    spark = edges.sparkSession
    area = work_area(spark, "orphans")
    syms = symbols.select("id", "indexed_at", "removed_at").unionByName(sdk_symbols.select("id", "indexed_at", "removed_at"))
    # of the rows with the latest time, any with removed_at set counts; rows that tie are identical
    of_syms = syms.groupBy("id").agg(F.max_by("removed_at", F.struct(F.col("indexed_at"), F.col("removed_at"))).isNotNull().alias("gone"), F.min("indexed_at").alias("first"))
    of_files = files.groupBy("id").agg(F.lit(False).alias("gone"), F.min("indexed_at").alias("first"))
    of_runs = runs.groupBy("id").agg((F.max_by("status", "created_at") == "deleted").alias("gone"), F.min("created_at").alias("first"))
    spaces = ((1, of_syms), (2, of_files), (3, of_runs))
    parents = None
    for n, p in spaces:
        p = p.select(F.lit(n).alias("space"), "id", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
        parents = p if parents is None else parents.unionByName(p)
    bound = syms.count() + files.count() + runs.count()

    space = lambda c: F.when(F.col(c).startswith("sym:"), 1).when(F.col(c).startswith("file:"), 2)
    ends = lambda d, *more: d.select(*more, F.explode(F.array(*[F.struct(F.lit(k).alias("ref_kind"), space(c).alias("space"), F.col(c).alias("id")) for k, c in ((1, "src_id"), (2, "dst_id"))])).alias("e")).select(*more, "e.*").where("space IS NOT NULL")
    of_edges = ends(latest(edges, ["id"], "indexed_at", ["src_id", "dst_id"]).select(F.col("id").alias("row_id"), F.col("indexed_at").alias("ref_at"), "src_id", "dst_id"), "row_id", "ref_at")
    named = F.col("run_id").isNotNull() & (F.col("run_id") != "")
    of_calls = latest(calls, ["id"], "logged_at", ["run_id", "called_at"]).where(named).select(F.col("id").alias("row_id"), F.col("called_at").alias("ref_at"), F.lit(3).alias("ref_kind"), F.lit(3).alias("space"), F.col("run_id").alias("id"))
    loads = ends(edges.select("src_id", "dst_id")).select("space", "id").unionByName(calls.where(named).select(F.lit(3).alias("space"), F.col("run_id").alias("id")))
    found = orphans(parents, of_edges.unionByName(of_calls), area, bound, loads)
    table = F.when(F.col("ref_kind") == 3, "ch_tool_calls").otherwise("edges")
    field = F.when(F.col("ref_kind") == 1, "src_id").when(F.col("ref_kind") == 2, "dst_id").otherwise("run_id")
    why = F.when(F.col("reason") == MISSING, "missing").when(F.col("reason") == DELETED, "deleted").otherwise("late")
    month = F.date_format(F.timestamp_micros("ref_at"), "yyyy-MM")
    return found.select(table.alias("source_table"), field.alias("ref_field"), "row_id", why.alias("reason"), month.alias("ref_month"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table, field, reason and month."""
    return found.groupBy("source_table", "ref_field", "reason", "ref_month").agg(F.count("*").alias("n_refs"))
