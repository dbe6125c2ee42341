"""Scans, one-hop joins and aggregations over a property graph of files, symbols and edges.

All functions take and return DataFrames; a graph's tables may hold many repositories. Limits come after a total order,
so that results do not depend on the plan. Missing texts read as empty where the functions say nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.current import latest_same
from codeloom.runtime import WorkArea, driver_tables, file_token

REFERENCES = ["calls", "reads", "inherits", "implements"]
DEPENDENCIES = [*REFERENCES, "imports"]


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


_LAID_OUT: dict[tuple[str, str], tuple] = {}
TABLES = ("files", "symbols", "sdk_symbols", "edges")


def load_graph(spark: SparkSession, folder: str) -> Graph:
    """Current rows of the graph tables; deleted symbols are left out, shared SDK symbols are in.

    They are found once a session and written to the shared folder: later queries read the few columns they want from
    there instead of aggregating all history again. A change of the source files makes them be found anew.
    """
    key, token = (spark.sparkContext.applicationId, folder), file_token(spark, *[f"{folder}/{t}.parquet" for t in TABLES])
    if key in _LAID_OUT and _LAID_OUT[key][0] == token:
        return _LAID_OUT[key][1]
    if key in _LAID_OUT:
        _LAID_OUT.pop(key)[2].close()
    g, area = current_graph(spark, folder), WorkArea(spark, "graph", kept=True)
    laid = Graph(area.put(g.files, "files"), area.put(g.symbols, "symbols"), area.put(g.edges, "edges"))
    _LAID_OUT[key] = (token, laid, area)
    return laid


def current_graph(spark: SparkSession, folder: str) -> Graph:
    """Current rows of the graph tables as a plan over all their rows."""
    files, symbols, sdk, edges = driver_tables(spark, folder, "files", "symbols", "sdk_symbols", "edges")
    live = latest_same(symbols, ["id"], "indexed_at").unionByName(latest_same(sdk, ["id"], "indexed_at")).where("removed_at IS NULL")
    return Graph(latest_same(files, ["id"], "indexed_at"), live.drop("indexed_at", "removed_at"), latest_same(edges, ["id"], "indexed_at").drop("indexed_at"))


def _at(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def symbols_by_name(symbols: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Symbols whose name contains ``name``, ignoring case: exact ones first, then those outside tests, then shorter names."""
    hit = symbols.where(F.contains(F.lower("name"), F.lit(name.lower())))
    rank = (F.when(F.lower("name") == name.lower(), 0).otherwise(1)).alias("tier")
    d = hit.select("id", "name", "path", rank, F.when(paths.path_flag("test", F.col("path")), 1).otherwise(0).alias("in_test"))
    return d if limit is None else d.orderBy("tier", "in_test", F.length("name"), "name", "path", "id").limit(limit)


def search_path(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols with the text in path, name or signature, ignoring case."""
    t = F.lit(text.lower())
    return symbols.where(F.contains(F.lower(_at("path")), t) | F.contains(F.lower(_at("name")), t) | F.contains(F.lower(_at("signature")), t))


def prefix_scan(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.where(F.lower("path").startswith(prefix.lower()))


def search_file_paths(files: DataFrame, terms: list[str]) -> DataFrame:
    """Files whose path contains any of the terms of three bytes or more."""
    hit = F.lit(False)
    for t in terms:
        if len(t.encode()) >= 3:
            hit = hit | F.contains(F.lower("path"), F.lit(t.lower()))
    return files.where(hit)


def files_by_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.lower("path").endswith(s.lower())
    return files.where(hit)


def callers(g: Graph, kinds: list[str] = REFERENCES) -> DataFrame:
    """Distinct (callee, caller) pairs where the caller is a known symbol; filter callee for one symbol's callers."""
    e = g.edges.where(F.col("kind").isin(kinds)).select(F.col("dst_id").alias("callee"), F.col("src_id").alias("caller"))
    return e.join(g.symbols.select(F.col("id").alias("caller")), "caller", "left_semi").distinct()


def callees(g: Graph) -> DataFrame:
    """(caller, callee) for calls to known symbols, one row per edge."""
    e = g.edges.where("kind = 'calls'").select(F.col("src_id").alias("caller"), F.col("dst_id").alias("callee"))
    return e.join(g.symbols.select(F.col("id").alias("callee")), "callee", "left_semi").select("caller", "callee")


def neighbors(g: Graph, incoming: bool = True, kinds: list[str] = DEPENDENCIES) -> DataFrame:
    """(node, neighbor, kind, confidence): one hop along or against the edges, to known symbols."""
    here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    e = g.edges.where(F.col("kind").isin(kinds)).select(F.col(here).alias("node"), F.col(there).alias("neighbor"), "kind", "confidence")
    return e.join(g.symbols.select(F.col("id").alias("neighbor")), "neighbor", "left_semi").select("node", "neighbor", "kind", "confidence")


def count_callers(g: Graph) -> DataFrame:
    e = g.edges.where(F.col("kind").isin(REFERENCES))
    return e.select("dst_id", "src_id").distinct().groupBy(F.col("dst_id").alias("callee")).agg(F.count("*").alias("n_callers"))


def importers(g: Graph) -> DataFrame:
    """(module, file_id) for import edges out of known files."""
    e = g.edges.where("kind = 'imports'").select(F.col("dst_id").alias("module"), F.col("src_id").alias("file_id"))
    return e.join(g.files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("module", "file_id")


def unreferenced(g: Graph, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    """Symbols of the kinds that no reference edge leads to."""
    used = g.edges.where(F.col("kind").isin(REFERENCES)).select(F.col("dst_id").alias("id"))
    return g.symbols.where(F.col("kind").isin(*kinds)).join(used, "id", "left_anti")


def dead_code(g: Graph) -> DataFrame:
    """Unreferenced symbols that nothing runs implicitly, with a confidence by exported and suspected dynamic use."""
    d = unreferenced(g).where(~paths.runtime_invoked(F.col("name"), _at("path")) & ~paths.path_flag("vendor", F.col("path")))
    exported = F.coalesce(paths.is_exported(F.col("name"), _at("language")), F.lit(True))
    suspect = paths.dispatch_suspect(F.col("name"))
    rank = F.when(~exported & ~suspect, 3).when(~exported & suspect, 2).when(exported & ~suspect, 1).otherwise(0)
    return d.select("id", "name", "kind", "path", exported.alias("exported"), suspect.alias("suspect"), rank.alias("confidence_rank"))


def in_degrees(edges: DataFrame, kinds: list[str] = ("calls",)) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("in_degree"))


def in_degrees_for(edges: DataFrame, ids: DataFrame, kinds: list[str] = ("calls",)) -> DataFrame:
    """In-degrees of the ids of another DataFrame only; the others are dropped before counting."""
    return in_degrees(edges.join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi"), kinds)


def top_hubs(g: Graph, limit: int = 25, over: int = 24) -> DataFrame:
    """The most-called symbols: of the ``limit * over`` with most call edges those outside vendored, test and style paths."""
    n = g.edges.where("kind = 'calls' AND dst_id LIKE 'sym:%'").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("n_callers"))
    known = g.symbols.select("id", "name", "path")
    first = n.join(known, "id").orderBy(F.desc("n_callers"), "id").limit(limit * over)
    ok = ~(paths.path_flag("vendor", F.col("path")) | paths.path_flag("test", F.col("path")) | paths.path_flag("demo", F.col("path")) | paths.path_flag("style", F.col("path")))
    return first.where(ok).orderBy(F.desc("n_callers"), "id").limit(limit)


def package_hubs(g: Graph) -> DataFrame:
    """Calls between directories: per called directory the calls and the distinct calling directories."""
    s = g.symbols.select("id", paths.dirname(F.col("path")).alias("dir"), "repo_id")
    e = g.edges.where("kind = 'calls'").select("src_id", "dst_id")
    e = e.join(s.select(F.col("id").alias("src_id"), F.concat_ws(":", "repo_id", "dir").alias("from_dir")), "src_id")
    e = e.join(s.select(F.col("id").alias("dst_id"), F.concat_ws(":", "repo_id", "dir").alias("package"), F.col("dir").alias("d")), "dst_id")
    e = e.where((F.col("from_dir") != F.col("package")) & (F.col("d") != ".") & ~paths.path_flag("vendor", F.concat("d", F.lit("/"))))
    pairs = e.groupBy("package", "from_dir").agg(F.count("*").alias("n"))
    return pairs.groupBy("package").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_packages"))


def language_health(g: Graph) -> DataFrame:
    """Per language: symbols, outgoing call edges and import edges of its files."""
    s = g.symbols.groupBy("language").agg(F.count("*").alias("n_symbols"))
    calls = g.edges.where("kind = 'calls'").select(F.col("src_id").alias("id")).join(g.symbols.select("id", "language"), "id").groupBy("language").agg(F.count("*").alias("n_calls"))
    imports = g.edges.where("kind = 'imports'").select(F.col("src_id").alias("id")).join(g.files.select("id", "language"), "id").groupBy("language").agg(F.count("*").alias("n_imports"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    key = lambda d, k: d.withColumnRenamed("language", k)
    both = s.join(key(calls, "l1"), F.col("language").eqNullSafe(F.col("l1")), "left").join(key(imports, "l2"), F.col("language").eqNullSafe(F.col("l2")), "left")
    return both.select("language", "n_symbols", zero("n_calls"), zero("n_imports"))


def graph_counts(g: Graph) -> DataFrame:
    one = lambda d, k: d.groupBy("repo_id").agg(F.count("*").alias(k))
    whole = one(g.files, "n_files").join(one(g.symbols, "n_symbols"), "repo_id", "full").join(one(g.edges, "n_edges"), "repo_id", "full")
    return whole.na.fill(0, ["n_files", "n_symbols", "n_edges"])


def graph_density(g: Graph) -> DataFrame:
    """Per language: resolved calls a symbol and the confidence in absence of callers that it allows."""
    h = language_health(g)
    ratio = F.col("n_calls") / F.col("n_symbols")
    floor = F.when(F.col("language").isin("ruby", "php", "python", "javascript"), 0.3).otherwise(0.5)
    return h.select("language", F.round(ratio, 6).alias("density"), F.when(F.col("n_calls") == 0, "none").when(ratio < floor / 2, "LOW").when(ratio < floor, "MEDIUM").otherwise("HIGH").alias("confidence"))


def methods_by_receiver(symbols: DataFrame) -> DataFrame:
    """(receiver, method) of the methods of each owner; owners are bare names or the names of owner ids."""
    owner = F.when(F.col("parent_id").startswith("sym:"), F.substring_index("parent_id", ":", -1)).otherwise(F.col("parent_id"))
    return symbols.where("kind = 'method' AND parent_id IS NOT NULL AND parent_id <> ''").select("repo_id", owner.alias("receiver"), F.col("name").alias("method")).distinct()


def implementations(g: Graph, least: int = 1) -> DataFrame:
    """Types that declare the methods of an interface: (interface, type, n_covered, n_methods, complete), joined on method names.

    Only method names of the same repository meet, so the join's size follows the number of shared methods.
    """
    m = methods_by_receiver(g.symbols)
    interfaces = g.symbols.where("kind = 'interface'").select("repo_id", F.col("name").alias("receiver")).distinct()
    wanted = m.join(interfaces, ["repo_id", "receiver"], "left_semi").withColumnRenamed("receiver", "interface")
    size = wanted.groupBy("repo_id", "interface").agg(F.count("*").alias("n_methods"))
    types = g.symbols.where("kind = 'class'").select("repo_id", F.col("name").alias("receiver")).distinct()
    own = m.join(types, ["repo_id", "receiver"], "left_semi").withColumnRenamed("receiver", "type")
    both = wanted.join(own, ["repo_id", "method"]).where("interface <> type").groupBy("repo_id", "interface", "type").agg(F.count("*").alias("n_covered"))
    r = both.join(size, ["repo_id", "interface"]).where(F.col("n_covered") >= least)
    return r.select("repo_id", "interface", "type", "n_covered", "n_methods", (F.col("n_covered") == F.col("n_methods")).alias("complete"))


def distinct_imports(g: Graph) -> DataFrame:
    """Distinct imported module paths that are not relative."""
    module = F.regexp_extract("dst_id", r"^mod:[^:]*:(.*)$", 1)
    return g.edges.where("kind = 'imports' AND dst_id LIKE 'mod:%'").select("repo_id", module.alias("module")).where("module NOT LIKE '.%'").distinct()


def ambiguous_names(symbols: DataFrame) -> DataFrame:
    """Names at more than one (repository, path)."""
    places = symbols.select("name", "repo_id", "path").distinct()
    return places.groupBy("name").agg(F.count("*").alias("n_places")).where("n_places > 1")


def edge_resolution(edges: DataFrame) -> DataFrame:
    """Per kind: edges that end in a symbol, and in an unresolved reference."""
    return edges.groupBy("kind").agg(F.count_if(F.col("dst_id").startswith("sym:")).alias("n_resolved"), F.count_if(F.col("dst_id").startswith("symref:")).alias("n_placeholders"))


def unresolved_split(g: Graph) -> DataFrame:
    """Unresolved references whose name some symbol bears (internal) and the rest (external)."""
    r = g.edges.where("dst_id LIKE 'symref:%'").select(paths.ref_name(F.col("dst_id")).alias("name"))
    known = g.symbols.select("name").distinct().withColumn("known", F.lit(True))
    return r.join(known, "name", "left").agg(F.count_if("known").alias("n_internal"), F.count_if(F.col("known").isNull()).alias("n_external"))


def public_api(g: Graph, limit: int = 60) -> DataFrame:
    """Exported symbols by callers, exported and kind bonus; the highest first."""
    n = count_callers(g).withColumnRenamed("callee", "id")
    exported = F.coalesce(paths.is_exported(F.col("name"), _at("language")), F.lit(True))
    bonus = F.when(F.col("kind").isin("class", "interface", "type_alias", "enum"), 0.2).when(F.col("kind") == "function", 0.1).otherwise(0.0)
    d = g.symbols.where(exported & ~paths.path_flag("test", F.col("path"))).join(n, "id", "left")
    score = F.log(1 + F.coalesce("n_callers", F.lit(0))) + 0.35 + bonus
    return d.select("id", "name", "kind", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def symbol_context(g: Graph, caller_limit: int = 5) -> DataFrame:
    """Per known symbol with callers: first callers in id order and the exact number of them, and of callees."""
    pairs = callers(g)
    w = Window.partitionBy("callee").orderBy("caller")
    first = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= caller_limit)
    first = first.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    total = pairs.groupBy("callee").agg(F.count("*").alias("n_callers"))
    out = callees(g).groupBy(F.col("caller").alias("callee")).agg(F.count("*").alias("n_callees"))
    d = total.join(first, "callee").join(g.symbols.select(F.col("id").alias("callee")), "callee", "left_semi").join(out, "callee", "left")
    return d.select(F.col("callee").alias("id"), F.array_join("callers", "|").alias("callers"), "n_callers", F.coalesce("n_callees", F.lit(0).cast("bigint")).alias("n_callees"))


def enclosing_symbols(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """places(path, line) -> the innermost symbol around each line, else the nearest one that starts before it.

    An equi-join on (repo_id, path) with the line condition on top; one row per place that has any candidate.
    """
    s = symbols.select("repo_id", "path", F.col("id").alias("symbol_id"), "line_start", "line_end")
    c = places.join(s, ["repo_id", "path"]).where("line_start <= line")
    inside = F.col("line_end") >= F.col("line")
    best = F.min(F.struct(F.when(inside, 0).otherwise(1).alias("outside"), F.when(inside, F.col("line_end") - F.col("line_start")).otherwise(F.col("line") - F.col("line_start")).alias("far"), "symbol_id"))
    return c.groupBy("repo_id", "path", "line").agg(best.alias("b")).select("repo_id", "path", "line", "b.symbol_id", (F.col("b.outside") == 0).alias("inside"))


def resolve_owners(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """imports(repo_id, module), roots(owner, root): the longest root that is a leading segment path of each import.

    Every prefix of an import becomes a key, so the prefix match is an equi-join and not a nested loop.
    """
    parts = F.split(F.lower("module"), "/")
    i = imports.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    hit = i.join(roots.select("owner", F.lower("root").alias("prefix")), "prefix").where("owner <> repo_id")
    best = hit.groupBy("repo_id", "module").agg(F.max(F.struct(F.length("prefix").alias("n"), "owner")).alias("b"))
    return best.select("repo_id", "module", "b.owner")


def merge_snapshots(g: Graph) -> DataFrame:
    """One row over all repositories: sums of counts and the sorted repository names."""
    c = graph_counts(g)
    return c.agg(F.sum("n_files").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.sum("n_edges").alias("n_edges"), F.count("*").alias("n_repos"))


def group_search(symbols: DataFrame, name: str, per_repo: int = 5) -> DataFrame:
    """The best hits for a name in every repository at once: exact names, then dotted suffixes; fixtures last."""
    n = F.lower("name")
    tier = F.when(n == name.lower(), 0).when(n.endswith("." + name.lower()), 1).otherwise(2)
    hit = symbols.where(F.contains(n, F.lit(name.lower()))).withColumn("tier", tier)
    hit = hit.withColumn("best", F.min("tier").over(Window.partitionBy("repo_id"))).where("tier = best")
    order = Window.partitionBy("repo_id").orderBy(F.when(paths.path_flag("fixture", F.col("path")), 1).otherwise(0), "path", "name", "id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_repo).select("repo_id", "id", "name", "rank")
