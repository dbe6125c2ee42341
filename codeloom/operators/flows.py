"""Request flows: from route or controller symbols along calls through the layers below, all entries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.graph import Graph
from codeloom.runtime import work_area


def entrypoints(g: Graph, limit: int | None = None, rules=paths.LAYER_RULES) -> DataFrame:
    """Symbols of the route and controller layers that are functions, methods or classes outside tests."""
    s = g.symbols.withColumn("layer", paths.flow_layer(F.col("name"), F.col("path"), F.col("signature"), rules))
    d = s.where(F.col("layer").isin("route", "controller") & F.col("kind").isin("function", "method", "class") & ~paths.path_flag("test", F.col("path"))).select("id", "name", "layer")
    return d if limit is None else d.orderBy("layer", "name", "id").limit(limit)


def spines(g: Graph, entries: DataFrame, depth: int = 8, fan_out: int = 12, rules=paths.LAYER_RULES) -> DataFrame:
    """(entry, path, layers, score): of the walks from each entry (never back, at most ``fan_out`` callees a node, a
    node kept on its best-scored walk only) the one with the best score, most layers and fewest steps.

    A step scores its layer, and 3 more when it goes no layer back.
    """
    spark = entries.sparkSession
    area = work_area(spark, "flows")
    s = g.symbols.select("id", paths.flow_layer(F.col("name"), F.col("path"), F.col("signature"), rules).alias("layer"))
    calls = g.edges.where("kind = 'calls'").select(F.col("src_id").alias("at"), F.col("dst_id").alias("to")).distinct().join(s.select(F.col("id").alias("to"), "layer"), "to")
    calls = calls.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc(paths.layer_score(F.col("layer"))), "to"))).where(F.col("r") <= fan_out).drop("r")
    calls = area.put(calls, "calls")
    order = F.array(*[F.lit(x) for x in ("route", "controller", "service", "query")])
    start = entries.select(F.col("id").alias("entry"), F.col("id").alias("at"), F.array("id").alias("path"), F.array("layer").alias("layers"), paths.layer_score(F.col("layer")).alias("score"))
    front = area.put(start, "level0")
    levels = [area.path("level0")]
    for k in range(1, depth + 1):
        n = front.join(calls, "at").where(~F.array_contains("path", F.col("to")))
        last = F.aggregate("layers", F.lit(0), lambda acc, x: F.when(x == "other", acc).otherwise(F.array_position(order, x).cast("int")))
        gain = F.when(F.col("layer") == "other", 0).otherwise(paths.layer_score(F.col("layer")) + F.when(F.array_position(order, F.col("layer")).cast("int") >= last, 3).otherwise(0))
        n = n.select("entry", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("layers", F.array("layer")).alias("layers"), (F.col("score") + gain).alias("score"))
        seen = spark.read.parquet(*levels).select("entry", "at")
        n = n.join(seen, ["entry", "at"], "left_anti").groupBy("entry", "at").agg(F.max_by(F.struct("path", "layers", "score"), F.struct("score", "path")).alias("b")).select("entry", "at", "b.*")
        front = area.put(n, f"level{k}")
        levels.append(area.path(f"level{k}"))
        if front.isEmpty():
            break
    whole = spark.read.parquet(*levels)
    distinct_layers = F.size(F.array_distinct(F.filter("layers", lambda x: x != "other")))
    best = whole.groupBy("entry").agg(F.max_by(F.struct("path", "layers", "score"), F.struct("score", distinct_layers, -F.size("path"), "path")).alias("b"))
    return best.select("entry", "b.*")


def request_flows(g: Graph, rules=paths.LAYER_RULES) -> DataFrame:
    """(id, name, entry, steps, layers): useful spines of two steps or more, which start at an entry layer or span two layers."""
    d = spines(g, entrypoints(g, rules=rules), rules=rules).where(F.size("path") >= 2)
    kinds = F.array_distinct(F.filter("layers", lambda x: x != "other"))
    d = d.where(F.element_at("layers", 1).isin("route", "controller") | (F.size(kinds) >= 2))
    d = d.join(g.symbols.select(F.col("id").alias("entry"), F.col("name").alias("entry_name")), "entry")
    return d.select(F.substring(F.sha2("entry", 256), 1, 16).alias("id"), F.concat(F.lit("flow:"), F.array_join(kinds, "→"), F.lit(":"), "entry_name").alias("name"), "entry", F.col("path").alias("steps"), "layers")


def clusters(g: Graph, found: DataFrame) -> DataFrame:
    """(name, node): members of a cluster per layer and per first word of the entry's name; exploded, not gathered."""
    from codeloom.functions.text import split_identifier

    steps = found.select("entry", F.explode(F.arrays_zip(F.col("steps").alias("node"), F.col("layers").alias("layer"))).alias("x")).select("entry", F.col("x.node").alias("node"), F.col("x.layer").alias("layer"))
    by_layer = steps.where("layer <> 'other'").select(F.concat(F.lit("layer:"), "layer").alias("name"), "node")
    family = g.symbols.select(F.col("id").alias("entry"), F.get(split_identifier(F.col("name")), 0).alias("w")).where("w IS NOT NULL")
    by_family = steps.join(family, "entry").select(F.concat(F.lit("family:"), "w").alias("name"), "node")
    return by_layer.unionByName(by_family).distinct()


def cluster_summary(members: DataFrame) -> DataFrame:
    """clusters' (name, node) -> (name, n_members, cohesion)."""
    n = members.groupBy("name").agg(F.count("*").alias("n_members"))
    return n.select("name", "n_members", paths.layer_cohesion(F.when(F.col("name").startswith("layer:"), F.expr("substring(name, 7)")).otherwise(F.lit("other")), F.col("n_members")).alias("cohesion"))


def persist(g: Graph, flows_table, clusters_table, rules=paths.LAYER_RULES) -> None:
    """Build the flows and clusters of the graph's repositories and let them replace what two tables (``KeyedTable``, by
    repo_id) hold of these."""
    found = work_area(g.symbols.sparkSession, "persist").put(request_flows(g, rules), "flows")
    of = g.symbols.select(F.col("id").alias("entry"), "repo_id")
    groups = g.symbols.select("repo_id").distinct()
    flows_table.replace(found.join(of, "entry").select("repo_id", "id", "name", "entry", "steps"), groups)
    members = clusters(g, found).join(g.symbols.select(F.col("id").alias("node"), "repo_id"), "node")
    n = members.groupBy("repo_id", "name").agg(F.count("*").alias("n_members"))
    layer = F.when(F.col("name").startswith("layer:"), F.expr("substring(name, 7)")).otherwise(F.lit("other"))
    clusters_table.replace(n.withColumn("cohesion", paths.layer_cohesion(layer, F.col("n_members"))), groups)
