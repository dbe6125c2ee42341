"""Level-synchronous breadth-first traversal: one join a level for all seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.graph import DEPENDENCIES, Graph
from codeloom.runtime import work_area


def arcs(g: Graph, direction: str = "upstream", kinds: list[str] = DEPENDENCIES) -> DataFrame:
    """(src, dst, confidence) to walk: upstream leads from a symbol to those that depend on it."""
    a, b = ("dst_id", "src_id") if direction == "upstream" else ("src_id", "dst_id")
    e = g.edges.where(F.col("kind").isin(kinds)).groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.max("confidence").alias("confidence"))
    return e.join(g.symbols.select(F.col("id").alias("dst")), "dst", "left_semi")


def reach(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """steps(src, dst[, ...]), seeds(seed, node) -> (seed, node, depth) with the least number of steps, seeds at 0.

    Every level is written and the join's plan chosen from its real size; nodes seen before are not walked again. Ends
    early when nothing new is reached.
    """
    spark = seeds.sparkSession
    area = work_area(spark, "reach")
    walk = area.put(steps.select("src", "dst").distinct(), "steps")
    front = area.put(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)), "level0")
    levels = [area.path("level0")]
    for k in range(1, depth + 1):
        new = front.select("seed", F.col("node").alias("src")).join(walk, "src").select("seed", F.col("dst").alias("node")).distinct()
        front = area.put(new.join(spark.read.parquet(*levels).select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)), f"level{k}")
        levels.append(area.path(f"level{k}"))
        if k < depth and front.isEmpty():
            break
    return spark.read.parquet(*levels)


def risk_tier(n):
    return F.when(n > 40, "high").when(n > 10, "medium").otherwise("low")


def impact(g: Graph, targets: DataFrame, depth: int = 2, direction: str = "upstream") -> DataFrame:
    """targets(seed) -> (seed, node, depth) of all symbols within ``depth`` steps, without the target itself."""
    return reach(arcs(g, direction), targets.select("seed", F.col("seed").alias("node")), depth).where("depth > 0")


def impact_summary(reached: DataFrame) -> DataFrame:
    n = reached.groupBy("seed").agg(F.count("*").alias("n_nodes"))
    return n.withColumn("tier", risk_tier(F.col("n_nodes")))


def affected_tests(g: Graph, targets: DataFrame, depth: int = 6, tests=None) -> DataFrame:
    """(node, depth): test symbols that reach any target, at their least distance.

    All targets start the walk together, so that it holds each node once and not once for each target. ``tests`` tells
    test symbols, by default by their path.
    """
    near = reach(arcs(g, "upstream"), targets.select(F.lit("all").alias("seed"), F.col("seed").alias("node")), depth).where("depth > 0")
    is_test = paths.path_flag("test", F.col("path")) if tests is None else tests
    return near.join(g.symbols.where(is_test).select(F.col("id").alias("node")), "node").select("node", "depth")


def shortest_paths(g: Graph, pairs: DataFrame, depth: int = 12, kinds: list[str] = ("calls",)) -> DataFrame:
    """pairs(src, dst) -> (src, dst, hops, path): a shortest call path of each pair that has one; of equals the least path.

    A level keeps one path for each (pair, node); a pair stops as soon as it has arrived.
    """
    spark = pairs.sparkSession
    area = work_area(spark, "paths")
    walk = area.put(g.edges.where(F.col("kind").isin(*kinds)).select(F.col("src_id").alias("at"), F.col("dst_id").alias("to")).distinct(), "steps")
    front = area.put(pairs.select("src", "dst").distinct().select("src", "dst", F.col("src").alias("at"), F.array("src").alias("path")), "level0")
    levels = [area.path("level0")]
    for k in range(1, depth + 1):
        seen = spark.read.parquet(*levels).select("src", "dst", F.col("at"))
        done = seen.where("at = dst").select("src", "dst")
        step = front.where("at <> dst").join(done, ["src", "dst"], "left_anti").join(walk, "at")
        step = step.groupBy("src", "dst", F.col("to").alias("at")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        front = area.put(step.join(seen, ["src", "dst", "at"], "left_anti"), f"level{k}")
        levels.append(area.path(f"level{k}"))
        if front.isEmpty():
            break
    return spark.read.parquet(*levels).where("at = dst").select("src", "dst", (F.size("path") - 1).alias("hops"), "path")


def call_flow(g: Graph, roots: DataFrame, depth: int = 3, steps: int = 60) -> DataFrame:
    """roots(seed) -> (seed, node, depth, step): the symbols called below a root in breadth-first order, at most ``steps``."""
    from pyspark.sql import Window

    r = reach(arcs(g, "downstream", ["calls"]), roots.select("seed", F.col("seed").alias("node")), depth).where("depth > 0")
    return r.withColumn("step", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("step") <= steps)


def expand_neighbors(g: Graph, seeds: DataFrame, hops: int = 2, per_seed: int = 24, total: int = 120) -> DataFrame:
    """seeds(node, score) -> (node, score): neighbours in both directions, decayed by hop and confidence.

    A hop takes at most ``per_seed`` neighbours of a node and direction (in id order); a node keeps its best score.
    """
    from pyspark.sql import Window

    e = g.edges.where(F.col("kind").isin(DEPENDENCIES))
    weight = F.when(F.col("kind") == "imports", 0.7).otherwise(1.0) * (0.5 + 0.5 * F.coalesce("confidence", F.lit(0.5)))
    both = e.select(F.col("src_id").alias("node"), F.col("dst_id").alias("to"), weight.alias("w"), F.lit(0).alias("way")).unionByName(e.select(F.col("dst_id").alias("node"), F.col("src_id").alias("to"), weight.alias("w"), F.lit(1).alias("way")))
    both = both.groupBy("node", "to", "way").agg(F.max("w").alias("w"))
    known = g.symbols.select(F.col("id").alias("to"))
    front, found = seeds.select("node", "score"), None
    for hop in range(1, hops + 1):
        # the frontier first, then the cap: only neighbours of reached nodes are ever ranked
        near = both.join(front, "node").join(known, "to", "left_semi")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("node", "way").orderBy("to"))).where(F.col("r") <= per_seed)
        front = near.groupBy(F.col("to").alias("node")).agg(F.max(F.col("score") * F.col("w") / (hop + 1)).alias("score"))
        found = front if found is None else found.unionByName(front)
    out = found.join(seeds.select("node"), "node", "left_anti").groupBy("node").agg(F.round(F.max("score"), 6).alias("score"))
    return out.orderBy(F.desc("score"), "node").limit(total)


def invalidation(g: Graph, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """seeds(repo_id, path) -> paths whose symbols depend on them, directly or not, with the distance."""
    s = g.symbols.select("id", F.concat_ws("\x00", "repo_id", "path").alias("key"))
    e = g.edges.where(F.col("kind").isin("calls", "imports")).select("src_id", "dst_id")
    steps = e.join(s.select(F.col("id").alias("src_id"), F.col("key").alias("dst")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("key").alias("src")), "dst_id").where("src <> dst")
    start = seeds.select(F.lit("all").alias("seed"), F.concat_ws("\x00", "repo_id", "path").alias("node"))
    r = reach(steps, start, rounds)
    return r.select(F.substring_index("node", "\x00", 1).alias("repo_id"), F.substring_index("node", "\x00", -1).alias("path"), "depth")
