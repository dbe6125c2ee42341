"""Queries over the code graph: scans, joins, aggregations, traversal and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import evolve, flows, graph, resolve, traverse, upsert
from codeloom.operators.current import latest
from codeloom.plans.base import GRAPH, query
from codeloom.runtime import driver_tables

HUB = "sym:harbor-sdk:internal/routing/panel.go:361:resolveSignal"
REFS = "('calls','reads','inherits','implements')"
DEPS = "('calls','reads','inherits','implements','imports')"


def dirname_sql(c: str) -> str:
    return f"CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '.' END"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({c}, '')), '{pattern}')"


NOT_HUB = f"NOT ({matches('path', paths.VENDOR)} OR {matches('path', paths.TEST)} OR {matches('path', paths.DEMO)} OR {matches('path', paths.STYLE)})"


@query(GRAPH + f"""
, n AS (SELECT dst_id AS id, count(*) AS n_callers FROM e WHERE kind = 'calls' AND dst_id LIKE 'sym:%' GROUP BY 1),
t AS (SELECT n.id, s.name, s.path, n_callers FROM n JOIN s USING (id) ORDER BY n_callers DESC, id LIMIT 600)
SELECT id, name, path, n_callers FROM t WHERE {NOT_HUB} ORDER BY n_callers DESC, id LIMIT 25""")
def top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_hubs(graph.load_graph(spark, d)).select("id", "name", "path", "n_callers")


@query(GRAPH + f"""
, p AS (SELECT id, repo_id || ':' || {dirname_sql('path')} AS pkg, {dirname_sql('path')} AS dir FROM s)
SELECT b.pkg AS package, count(*)::BIGINT AS n_calls, count(DISTINCT a.pkg)::BIGINT AS n_packages
FROM e JOIN p a ON e.src_id = a.id JOIN p b ON e.dst_id = b.id
WHERE e.kind = 'calls' AND a.pkg <> b.pkg AND b.dir <> '.' AND NOT {matches("b.dir || '/'", paths.VENDOR)} GROUP BY 1""")
def package_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.package_hubs(graph.load_graph(spark, d))


@query(GRAPH + f"SELECT DISTINCT e.dst_id AS callee, e.src_id AS caller FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {REFS}")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(graph.load_graph(spark, d)).select("callee", "caller")


@query(GRAPH + f"SELECT DISTINCT e.src_id AS caller FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {REFS} AND e.dst_id = '{HUB}'")
def callers_of_hub(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(graph.load_graph(spark, d)).where(F.col("callee") == HUB).select("caller")


@query(GRAPH + "SELECT e.src_id AS caller, e.dst_id AS callee FROM e JOIN s ON s.id = e.dst_id WHERE e.kind = 'calls'")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(graph.load_graph(spark, d))


@query(GRAPH + f"SELECT e.dst_id AS node, e.src_id AS neighbor, e.kind, e.confidence FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {DEPS}")
def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(graph.load_graph(spark, d))


@query(GRAPH + f"SELECT e.src_id AS node, e.dst_id AS neighbor, e.kind, e.confidence FROM e JOIN s ON s.id = e.dst_id WHERE e.kind IN {DEPS}")
def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(graph.load_graph(spark, d), incoming=False)


@query(GRAPH + f"SELECT dst_id AS callee, count(DISTINCT src_id)::BIGINT AS n_callers FROM e WHERE kind IN {REFS} GROUP BY 1")
def count_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_callers(graph.load_graph(spark, d))


@query(GRAPH + "SELECT e.dst_id AS module, e.src_id AS file_id FROM e JOIN f ON f.id = e.src_id WHERE e.kind = 'imports'")
def importers(spark: SparkSession, d: str) -> DataFrame:
    return graph.importers(graph.load_graph(spark, d))


@query(GRAPH + f"SELECT id, name, kind FROM s WHERE kind IN ('function','method','class') AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst_id = s.id AND e.kind IN {REFS})")
def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreferenced(graph.load_graph(spark, d)).select("id", "name", "kind")


_EXPORTED = "coalesce(CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN false WHEN coalesce(language, '') = 'go' THEN regexp_matches(name, '^\\p{Lu}') ELSE true END, true)"


@query(GRAPH + f"""
, u AS (SELECT *, {_EXPORTED} AS exported, regexp_matches(lower(name), '{paths.SUSPECT}') AS suspect FROM s WHERE kind IN ('function','method','class')
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst_id = s.id AND e.kind IN {REFS})
  AND NOT (regexp_matches(lower(name), '{paths.RUNTIME.lower()}') OR {matches('path', paths.TEST)}) AND NOT {matches('path', paths.VENDOR)})
SELECT id, name, kind, path, exported, suspect, (CASE WHEN NOT exported AND NOT suspect THEN 3 WHEN NOT exported THEN 2 WHEN NOT suspect THEN 1 ELSE 0 END)::INT AS confidence_rank FROM u""")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return graph.dead_code(graph.load_graph(spark, d))


@query(GRAPH + "SELECT dst_id AS id, count(*)::BIGINT AS in_degree FROM e WHERE kind = 'calls' GROUP BY 1")
def in_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degrees(graph.load_graph(spark, d).edges)


@query(GRAPH + "SELECT dst_id AS id, count(*)::BIGINT AS in_degree FROM e WHERE kind = 'calls' AND dst_id IN (SELECT id FROM sdk_symbols) GROUP BY 1")
def in_degrees_for(spark: SparkSession, d: str) -> DataFrame:
    (sdk,) = driver_tables(spark, d, "sdk_symbols")
    return graph.in_degrees_for(graph.load_graph(spark, d).edges, sdk.select("id"))


@query(GRAPH + """
, a AS (SELECT language, count(*)::BIGINT AS n_symbols FROM s GROUP BY 1),
b AS (SELECT s.language, count(*)::BIGINT AS n FROM e JOIN s ON s.id = e.src_id WHERE e.kind = 'calls' GROUP BY 1),
c AS (SELECT f.language, count(*)::BIGINT AS n FROM e JOIN f ON f.id = e.src_id WHERE e.kind = 'imports' GROUP BY 1)
SELECT a.language, n_symbols, coalesce(b.n, 0) AS n_calls, coalesce(c.n, 0) AS n_imports
FROM a LEFT JOIN b ON a.language IS NOT DISTINCT FROM b.language LEFT JOIN c ON a.language IS NOT DISTINCT FROM c.language""")
def language_health(spark: SparkSession, d: str) -> DataFrame:
    return graph.language_health(graph.load_graph(spark, d))


@query(GRAPH + """
, a AS (SELECT language, count(*) AS n_symbols FROM s GROUP BY 1),
b AS (SELECT s.language, count(*) AS n FROM e JOIN s ON s.id = e.src_id WHERE e.kind = 'calls' GROUP BY 1),
r AS (SELECT a.language, coalesce(b.n, 0) AS n, coalesce(b.n, 0) / n_symbols AS ratio, CASE WHEN a.language IN ('ruby','php','python','javascript') THEN 0.3 ELSE 0.5 END AS floor
  FROM a LEFT JOIN b ON a.language IS NOT DISTINCT FROM b.language)
SELECT language, round(ratio, 6) AS density, CASE WHEN n = 0 THEN 'none' WHEN ratio < floor / 2 THEN 'LOW' WHEN ratio < floor THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM r""")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_density(graph.load_graph(spark, d))


@query(GRAPH + """
, a AS (SELECT repo_id, count(*)::BIGINT AS n FROM f GROUP BY 1), b AS (SELECT repo_id, count(*)::BIGINT AS n FROM s GROUP BY 1), c AS (SELECT repo_id, count(*)::BIGINT AS n FROM e GROUP BY 1),
r AS (SELECT repo_id FROM a UNION SELECT repo_id FROM b UNION SELECT repo_id FROM c)
SELECT r.repo_id, coalesce(a.n, 0) AS n_files, coalesce(b.n, 0) AS n_symbols, coalesce(c.n, 0) AS n_edges FROM r LEFT JOIN a USING (repo_id) LEFT JOIN b USING (repo_id) LEFT JOIN c USING (repo_id)""")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_counts(graph.load_graph(spark, d))


@query(GRAPH + """
SELECT (SELECT count(*) FROM f)::BIGINT AS n_files, (SELECT count(*) FROM s)::BIGINT AS n_symbols, (SELECT count(*) FROM e)::BIGINT AS n_edges,
  (SELECT count(*) FROM (SELECT repo_id FROM f UNION SELECT repo_id FROM s UNION SELECT repo_id FROM e))::BIGINT AS n_repos""")
def merged_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_snapshots(graph.load_graph(spark, d))


_OWNER = "CASE WHEN parent_id LIKE 'sym:%' THEN regexp_extract(parent_id, '[^:]*$') ELSE parent_id END"
_METHODS = f"m AS (SELECT DISTINCT repo_id, {_OWNER} AS receiver, name AS method FROM s WHERE kind = 'method' AND parent_id <> '')"


@query(GRAPH + f", {_METHODS} SELECT repo_id, receiver, method FROM m")
def methods_by_receiver(spark: SparkSession, d: str) -> DataFrame:
    return graph.methods_by_receiver(graph.load_graph(spark, d).symbols)


@query(GRAPH + f""", {_METHODS},
w AS (SELECT m.repo_id, receiver AS interface, method FROM m WHERE (repo_id, receiver) IN (SELECT repo_id, name FROM s WHERE kind = 'interface')),
o AS (SELECT m.repo_id, receiver AS type, method FROM m WHERE (repo_id, receiver) IN (SELECT repo_id, name FROM s WHERE kind = 'class')),
z AS (SELECT repo_id, interface, count(*)::BIGINT AS n_methods FROM w GROUP BY ALL),
c AS (SELECT w.repo_id, w.interface, o.type, count(*)::BIGINT AS n_covered FROM w JOIN o ON w.repo_id = o.repo_id AND w.method = o.method AND w.interface <> o.type GROUP BY ALL)
SELECT c.repo_id, c.interface, c.type, n_covered, n_methods, n_covered = n_methods AS complete FROM c JOIN z ON c.repo_id = z.repo_id AND c.interface = z.interface""")
def implementations(spark: SparkSession, d: str) -> DataFrame:
    return graph.implementations(graph.load_graph(spark, d))


@query(GRAPH + "SELECT DISTINCT repo_id, regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1) AS module FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%' AND regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1) NOT LIKE '.%'")
def distinct_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_imports(graph.load_graph(spark, d))


@query(GRAPH + "SELECT name, count(DISTINCT (repo_id, path))::BIGINT AS n_places FROM s GROUP BY 1 HAVING count(DISTINCT (repo_id, path)) > 1")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous_names(graph.load_graph(spark, d).symbols)


@query(GRAPH + "SELECT kind, (count(*) FILTER (dst_id LIKE 'sym:%'))::BIGINT AS n_resolved, (count(*) FILTER (dst_id LIKE 'symref:%'))::BIGINT AS n_placeholders FROM e GROUP BY 1")
def edge_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_resolution(graph.load_graph(spark, d).edges)


@query(GRAPH + """, r AS (SELECT regexp_extract(dst_id, '[^:]*$') AS name FROM e WHERE dst_id LIKE 'symref:%')
SELECT (count(*) FILTER (name IN (SELECT name FROM s)))::BIGINT AS n_internal, (count(*) FILTER (name NOT IN (SELECT name FROM s)))::BIGINT AS n_external FROM r""")
def unresolved_split(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved_split(graph.load_graph(spark, d))


@query(GRAPH + f"""
, n AS (SELECT dst_id AS id, count(DISTINCT src_id) AS c FROM e WHERE kind IN {REFS} GROUP BY 1)
SELECT s.id, s.name, s.kind, round(ln(1 + coalesce(c, 0)) + 0.35 + CASE WHEN kind IN ('class','interface','type_alias','enum') THEN 0.2 WHEN kind = 'function' THEN 0.1 ELSE 0 END, 6) AS score
FROM s LEFT JOIN n USING (id) WHERE {_EXPORTED} AND NOT {matches('path', paths.TEST)} ORDER BY score DESC, id LIMIT 60""")
def public_api(spark: SparkSession, d: str) -> DataFrame:
    return graph.public_api(graph.load_graph(spark, d))


@query(GRAPH + f"""
, p AS (SELECT DISTINCT e.dst_id AS id, e.src_id AS caller FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {REFS}),
o AS (SELECT e.src_id AS id, count(*)::BIGINT AS n FROM e JOIN s ON s.id = e.dst_id WHERE e.kind = 'calls' GROUP BY 1),
c AS (SELECT id, array_to_string(list_sort(list(caller))[1:5], '|') AS callers, count(*)::BIGINT AS n_callers FROM p GROUP BY 1)
SELECT c.id, callers, n_callers, coalesce(o.n, 0) AS n_callees FROM c JOIN s USING (id) LEFT JOIN o USING (id)""")
def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbol_context(graph.load_graph(spark, d))


@query(GRAPH + f"""
SELECT id, name, path, (CASE WHEN lower(name) = 'resolvesignal' THEN 0 ELSE 1 END)::INT AS tier, (CASE WHEN {matches('path', paths.TEST)} THEN 1 ELSE 0 END)::INT AS in_test
FROM s WHERE contains(lower(name), 'resolvesignal')""")
def symbols_by_name(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols_by_name(graph.load_graph(spark, d).symbols, "resolveSignal").select("id", "name", "path", "tier", "in_test")


@query(GRAPH + "SELECT id FROM s WHERE contains(lower(coalesce(path, '')), 'ledger') OR contains(lower(coalesce(name, '')), 'ledger') OR contains(lower(coalesce(signature, '')), 'ledger')")
def search_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_path(graph.load_graph(spark, d).symbols, "ledger").select("id")


@query(GRAPH + "SELECT id, path FROM s WHERE lower(path) LIKE 'src/%'")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return graph.prefix_scan(graph.load_graph(spark, d).symbols, "src/").select("id", "path")


@query(GRAPH + "SELECT id, path FROM f WHERE contains(lower(path), 'invoice') OR contains(lower(path), 'render')")
def search_file_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_file_paths(graph.load_graph(spark, d).files, ["invoice", "render", "x"]).select("id", "path")


@query(GRAPH + "SELECT id, path FROM f WHERE lower(path) LIKE '%.lock' OR lower(path) LIKE '%.min.js'")
def files_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return graph.files_by_suffix(graph.load_graph(spark, d).files, [".lock", ".min.js"]).select("id", "path")


@query(GRAPH + "SELECT DISTINCT repo_id, path FROM s")
def symbol_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_graph(spark, d).symbols.select("repo_id", "path").distinct()


@query(GRAPH + ", " + "p AS (SELECT id, lower(coalesce(path, '')) AS p FROM f) SELECT id, " + ", ".join(f"regexp_matches(p, '{v}') AS is_{k}" for k, v in paths.FLAGS.items()) + " FROM p")
def path_flags(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_graph(spark, d).files.select("id", *[paths.path_flag(k, F.col("path")).alias(f"is_{k}") for k in paths.FLAGS])


_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())


@query(GRAPH + f""", p AS (SELECT id, path, lower(regexp_extract(path, '[^/]*$')) AS n FROM f)
SELECT id, CASE WHEN n LIKE 'dockerfile%' THEN 'docker' WHEN n = 'makefile' THEN 'make' ELSE CASE CASE WHEN contains(n, '.') THEN regexp_extract(n, '[^.]*$') ELSE '' END {_LANG} ELSE 'text' END END AS language,
  {dirname_sql('path')} AS dir, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM p""")
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return graph.load_graph(spark, d).files.select("id", paths.language_of(p).alias("language"), paths.dirname(p).alias("dir"), paths.strip_extension(p).alias("stem"))


#: Layers of the graph in the tables: the usual rules, and folders and names that stand for routes and controllers there.
TABLE_LAYERS = (("route", paths.LAYER_RULES[0][1] + r"|/(routing|search)[0-9]*/", paths.LAYER_RULES[0][2]), ("controller", paths.LAYER_RULES[1][1], paths.LAYER_RULES[1][2] + "|manager$"), *paths.LAYER_RULES[2:])


def layer_sql(rules, name: str = "n", path: str = "p", signature: str = "sig") -> str:
    cases = [f"WHEN regexp_matches({path}, '{a}') OR regexp_matches({name}, '{b}')" + (f" OR contains({signature}, 'role=entrypoint')" if k == "route" else "") + f" THEN '{k}'" for k, a, b in rules]
    return "CASE " + " ".join(cases) + " ELSE 'other' END"


_LAYER = layer_sql(TABLE_LAYERS)
_NAMED = "t AS (SELECT id, kind, lower(coalesce(name, '')) AS n, lower(coalesce(path, '')) AS p, lower(coalesce(signature, '')) AS sig FROM s)"


@query(GRAPH + f""", {_NAMED} SELECT id, {layer_sql(TABLE_LAYERS)} AS layer FROM t WHERE kind IN ('function','method','class') AND NOT {matches('p', paths.TEST)} AND {layer_sql(TABLE_LAYERS)} IN ('route','controller')""")
def flow_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return flows.entrypoints(graph.load_graph(spark, d), rules=TABLE_LAYERS).select("id", "layer")


@query(GRAPH + f""", {_NAMED}
SELECT id, {_LAYER} AS layer,
  CASE WHEN regexp_matches(p, '{paths.TEST}') THEN 'test' WHEN regexp_matches(p, '{paths.ENTRY}') THEN 'entrypoint' WHEN regexp_matches(p, '{paths.DEPENDENCY}') THEN 'dependency' WHEN regexp_matches(p, '{paths.CONFIG}') THEN 'config' ELSE 'implementation' END AS context_kind,
  CASE WHEN regexp_matches(p, '{paths.MONEY}') THEN 'money' WHEN regexp_matches(p, '{paths.AUTH}') THEN 'auth' ELSE 'behaviour' END AS risk
FROM t""")
def symbol_classes(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    return s.select("id", paths.flow_layer(F.col("name"), F.col("path"), F.col("signature"), TABLE_LAYERS).alias("layer"), paths.context_kind(F.col("path")).alias("context_kind"), paths.test_risk(F.coalesce("path", F.lit(""))).alias("risk"))


# traversal -----------------------------------------------------------------------------------------------------------

_UP = f"a AS (SELECT DISTINCT e.dst_id AS src, e.src_id AS dst FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {DEPS})"
_DOWN = f"a AS (SELECT DISTINCT e.src_id AS src, e.dst_id AS dst FROM e JOIN s ON s.id = e.dst_id WHERE e.kind IN {DEPS})"


def _bfs(arcs: str, seeds: str, depth: int) -> str:
    return f""", {arcs}, w AS (SELECT seed, node, 0 AS depth FROM ({seeds}) UNION SELECT w.seed, a.dst, w.depth + 1 FROM w JOIN a ON a.src = w.node WHERE w.depth < {depth}),
r AS (SELECT seed, node, min(depth)::INT AS depth FROM w GROUP BY ALL) """


@query(GRAPH + _bfs(_UP, f"SELECT '{HUB}' AS seed, '{HUB}' AS node", 2) + "SELECT node, depth FROM r WHERE depth > 0")
def impact_up(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(HUB,)], "seed string")
    return traverse.impact(graph.load_graph(spark, d), targets).select("node", "depth")


@query(GRAPH + _bfs(_UP, "SELECT id AS seed, id AS node FROM sdk_symbols", 3) + "SELECT seed, count(*)::BIGINT AS n_nodes, CASE WHEN count(*) > 40 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END AS tier FROM r WHERE depth > 0 GROUP BY 1")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    (sdk,) = driver_tables(spark, d, "sdk_symbols")
    return traverse.impact_summary(traverse.impact(graph.load_graph(spark, d), sdk.select(F.col("id").alias("seed")), 3))


@query(GRAPH + _bfs(_DOWN, "SELECT id AS seed, id AS node FROM s WHERE name LIKE 'main%' OR kind = 'module'", 2) + "SELECT seed, node, depth FROM r WHERE depth > 0")
def impact_down(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return traverse.impact(g, g.symbols.where("name LIKE 'main%' OR kind = 'module'").select(F.col("id").alias("seed")), 2, "downstream")


@query(GRAPH + _bfs(_UP, "SELECT id AS seed, id AS node FROM s WHERE kind = 'interface'", 3) + "SELECT node, min(depth)::INT AS depth FROM r JOIN s ON s.id = r.node WHERE regexp_matches(name, '^(check|verify)') AND node NOT IN (SELECT id FROM s WHERE kind = 'interface') GROUP BY 1")
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return traverse.affected_tests(g, g.symbols.where("kind = 'interface'").select(F.col("id").alias("seed")), 3, F.col("name").rlike("^(check|verify)"))


_CHANGED = "c AS (SELECT repo_id, path FROM f WHERE indexed_at >= (SELECT max(indexed_at) FROM f) - INTERVAL 10 DAY)"


def changed_files(g: graph.Graph) -> DataFrame:
    """Files indexed in the last ten days before the newest."""
    newest = g.files.agg(F.max("indexed_at")).scalar()
    return g.files.where(F.col("indexed_at") >= newest - F.expr("INTERVAL 10 DAY")).select("repo_id", "path")


@query(GRAPH + f", {_CHANGED} SELECT s.id FROM s JOIN c USING (repo_id, path)")
def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return g.symbols.join(changed_files(g), ["repo_id", "path"], "left_semi").select("id")


@query(GRAPH + f", {_CHANGED}" + _bfs(_UP, "SELECT 'all' AS seed, s.id AS node FROM s JOIN c USING (repo_id, path)", 2) + "SELECT node, depth FROM r")
def since(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    seeds = g.symbols.join(changed_files(g), ["repo_id", "path"], "left_semi").select(F.lit("all").alias("seed"), F.col("id").alias("node"))
    return traverse.reach(traverse.arcs(g), seeds, 2).select("node", "depth")


@query(GRAPH + f""", {_CHANGED}, k AS (SELECT id, repo_id || '|' || path AS key FROM s),
a AS (SELECT DISTINCT t.key AS src, h.key AS dst FROM e JOIN k h ON h.id = e.src_id JOIN k t ON t.id = e.dst_id WHERE e.kind IN ('calls','imports') AND h.key <> t.key),
w AS (SELECT repo_id || '|' || path AS node, 0 AS depth FROM c UNION SELECT a.dst, w.depth + 1 FROM w JOIN a ON a.src = w.node WHERE w.depth < 3)
SELECT split_part(node, '|', 1) AS repo_id, split_part(node, '|', 2) AS path, min(depth)::INT AS depth FROM w GROUP BY ALL""")
def invalidation(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return traverse.invalidation(g, changed_files(g))


_CALLS = "c AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM e WHERE kind = 'calls')"


@query(GRAPH + f""", {_CALLS}, pairs AS (SELECT m.id AS src, '{HUB}' AS dst FROM s m WHERE m.kind = 'module'),
w AS (SELECT src, dst, src AS n, 0 AS hops FROM pairs UNION SELECT w.src, w.dst, c.b, w.hops + 1 FROM w JOIN c ON c.a = w.n WHERE w.n <> w.dst AND w.hops < 6)
SELECT src, dst, min(hops)::INT AS hops FROM w WHERE n = dst GROUP BY ALL""")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    pairs = g.symbols.where("kind = 'module'").select(F.col("id").alias("src"), F.lit(HUB).alias("dst"))
    return traverse.shortest_paths(g, pairs, 6).select("src", "dst", "hops")


@query(GRAPH + _bfs("a AS (SELECT DISTINCT e.src_id AS src, e.dst_id AS dst FROM e JOIN s ON s.id = e.dst_id WHERE e.kind = 'calls')", "SELECT id AS seed, id AS node FROM s WHERE kind = 'module'", 3) + ", o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node)::INT AS step FROM r WHERE depth > 0) SELECT seed, node, depth, step FROM o WHERE step <= 60")
def call_flow(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return traverse.call_flow(g, g.symbols.where("kind = 'module'").select(F.col("id").alias("seed")))


@query(GRAPH + f""", seeds AS (SELECT id AS node, 1.0 AS score FROM s WHERE kind = 'module'),
x AS (SELECT src_id, dst_id, CASE WHEN kind = 'imports' THEN 0.7 ELSE 1.0 END * (0.5 + 0.5 * coalesce(confidence, 0.5)) AS w FROM e WHERE kind IN {DEPS}),
b AS (SELECT node, nxt, way, max(w) AS w FROM (SELECT src_id AS node, dst_id AS nxt, w, 0 AS way FROM x UNION ALL SELECT dst_id, src_id, w, 1 FROM x) GROUP BY ALL),
h AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY node, way ORDER BY nxt) AS r FROM b WHERE nxt IN (SELECT id FROM s)) WHERE r <= 24),
h1 AS (SELECT h.nxt AS node, max(seeds.score * w / 2) AS score FROM h JOIN seeds USING (node) GROUP BY 1),
h2 AS (SELECT h.nxt AS node, max(h1.score * w / 3) AS score FROM h JOIN h1 USING (node) GROUP BY 1)
SELECT node, round(max(score), 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node NOT IN (SELECT node FROM seeds) GROUP BY 1 ORDER BY score DESC, node LIMIT 120""")
def expand_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return traverse.expand_neighbors(g, g.symbols.where("kind = 'module'").select(F.col("id").alias("node"), F.lit(1.0).alias("score")))


@query()
def request_flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.request_flows(graph.load_graph(spark, d), TABLE_LAYERS)


@query()
def flow_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return flows.clusters(g, flows.request_flows(g, TABLE_LAYERS))


# resolution and upserts ------------------------------------------------------------------------------------------------

_ROOT = "regexp_extract({}, '^((?:packages|apps|services|sample|samples|libs|modules)/[^/]+)/', 1)"
_STEPS = range(len(resolve.STRATEGIES))


def resolved_sql(edges: str) -> str:
    """CTEs up to ``res``: the cascade over every pair of a reference and a candidate of its name."""
    tests = {
        0: "true", 1: "owner = recv_owner", 2: "edge_kind IN ('inherits','implements') AND ck IN ('class','interface','struct')", 3: "cp = ref_path",
        4: f"EXISTS (SELECT 1 FROM m WHERE m.r = ref_repo AND m.pth = ref_path AND m.module IN (regexp_replace(cp, '\\.[^./]*$', ''), {dirname_sql('cp')}))",
        5: f"{dirname_sql('cp')} = {dirname_sql('ref_path')}", 6: f"{_ROOT.format('ref_path')} <> '' AND {_ROOT.format('ref_path')} = {_ROOT.format('cp')}",
        7: f"NOT {matches('cp', paths.FIXTURE)}", 8: f"NOT {matches('cp', paths.VENDOR)}", 9: "regexp_matches(lower(cp), '\\.(c|cc|cpp|cxx)$')",
    }
    typed = "regexp_matches(full_name, '^[A-Z][^.]*(\\..*)?\\.[^.]+$')"
    return f""", p0 AS (SELECT id AS edge_id, kind AS edge_kind, src_id, split_part(dst_id, ':', 2) AS ref_repo, regexp_extract(dst_id, '^symref:[^:]*:(.*):[^:]*$', 1) AS ref_path, regexp_extract(dst_id, '[^:]*$') AS full_name FROM {edges} WHERE dst_id LIKE 'symref:%'),
p AS (SELECT * EXCLUDE (full_name), CASE WHEN {typed} THEN regexp_extract(full_name, '[^.]*$') ELSE full_name END AS name, CASE WHEN {typed} THEN regexp_extract(regexp_replace(full_name, '\\.[^.]+$', ''), '[^.]*$') END AS recv_owner FROM p0),
x AS (SELECT p.*, s.id AS cand, s.path AS cp, s.kind AS ck, CASE WHEN starts_with(parent_id, 'sym:') THEN regexp_extract(parent_id, '[^:]*$') ELSE parent_id END AS owner, count(*) OVER (PARTITION BY edge_id) AS n_all FROM p JOIN s ON s.repo_id = p.ref_repo AND s.name = p.name),
sole AS (SELECT edge_id, src_id, cand AS dst_id, 'unique' AS strategy FROM x WHERE n_all = 1 AND cand <> src_id),
m AS (SELECT split_part(src_id, ':', 2) AS r, split_part(src_id, ':', 3) AS pth, regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1) AS module FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%'),
y AS (SELECT *, {", ".join(f"coalesce({t}, false) AS f{i}" for i, t in tests.items())} FROM x WHERE n_all > 1 AND cand <> src_id),
z AS (SELECT *, {", ".join(f"count(*) FILTER (f{i}) OVER (PARTITION BY edge_id) AS n{i}" for i in _STEPS)} FROM y),
v AS (SELECT *, CASE {" ".join(f"WHEN n{i} = 1 THEN {i}" for i in _STEPS)} END AS pick FROM z),
won AS (SELECT edge_id, src_id, cand AS dst_id, {resolve.STRATEGIES}[pick + 1] AS strategy FROM v WHERE {" OR ".join(f"(pick = {i} AND f{i})" for i in _STEPS)}),
res AS (SELECT * FROM sole UNION ALL SELECT * FROM won) """


_RES = resolved_sql("e")
_STAMP = "CASE strategy " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in resolve.CONFIDENCE.items()) + " END::DOUBLE"


@query(GRAPH + f""", o AS (SELECT id, name, CASE WHEN starts_with(parent_id, 'sym:') THEN regexp_extract(parent_id, '[^:]*$') ELSE parent_id END AS own FROM s WHERE kind = 'method' AND parent_id <> ''),
e2 AS (SELECT e.id, e.kind, src_id, 'symref:' || split_part(src_id, ':', 2) || ':' || split_part(src_id, ':', 3) || ':' || own || '.' || name AS dst_id FROM e JOIN o ON o.id = e.dst_id WHERE e.kind = 'calls' AND src_id LIKE 'sym:%')
""" + resolved_sql("e2") + f"SELECT edge_id, dst_id, strategy, {_STAMP} AS confidence FROM res")
def resolve_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Calls of methods, turned back into ``Type.method`` references and resolved again."""
    g = graph.load_graph(spark, d)
    own = F.when(F.col("parent_id").startswith("sym:"), F.substring_index("parent_id", ":", -1)).otherwise(F.col("parent_id"))
    m = g.symbols.where("kind = 'method' AND parent_id <> ''").select(F.col("id").alias("dst_id"), F.concat_ws(".", own, "name").alias("ref"))
    e = g.edges.where("kind = 'calls' AND src_id LIKE 'sym:%'").select("repo_id", "id", "kind", "src_id", "dst_id", "confidence").join(m, "dst_id")
    place = F.split("src_id", ":")
    back = e.withColumn("dst_id", F.concat_ws(":", F.lit("symref"), place[1], place[2], "ref")).select("repo_id", "id", "kind", "src_id", "dst_id", "confidence")
    imports = g.edges.where("kind = 'imports'").select(*back.columns)
    return resolve.resolve(graph.Graph(g.files, g.symbols, back.unionByName(imports))).select("edge_id", "dst_id", "strategy", "confidence")


@query(GRAPH + _RES + "SELECT edge_id, src_id, dst_id, strategy, CASE strategy " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in resolve.CONFIDENCE.items()) + " END::DOUBLE AS confidence FROM res")
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(graph.load_graph(spark, d))


@query(GRAPH + _RES + """
SELECT (SELECT count(*) FROM p)::BIGINT AS total, (SELECT count(*) FROM res)::BIGINT AS resolved,
  (SELECT count(*) FROM p WHERE edge_id NOT IN (SELECT edge_id FROM res) AND (ref_repo, name) IN (SELECT repo_id, name FROM s))::BIGINT AS ambiguous,
  (SELECT count(*) FROM p WHERE edge_id NOT IN (SELECT edge_id FROM res) AND (ref_repo, name) NOT IN (SELECT repo_id, name FROM s))::BIGINT AS unresolved""")
def resolve_stats(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolution_stats(graph.load_graph(spark, d))


@query(GRAPH + _RES + """, c AS (SELECT edge_id, src_id, dst_id, CASE strategy """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in resolve.CONFIDENCE.items()) + """ END::DOUBLE AS confidence FROM res),
u AS (SELECT repo_id, id, kind, src_id, dst_id, confidence FROM e WHERE id NOT IN (SELECT edge_id FROM c)
  UNION ALL SELECT e.repo_id, 'e:' || e.repo_id || ':' || c.src_id || ':' || e.kind || ':' || c.dst_id, e.kind, c.src_id, c.dst_id, c.confidence FROM e JOIN c ON c.edge_id = e.id)
SELECT id, any_value(repo_id) AS repo_id, any_value(kind) AS kind, any_value(src_id) AS src_id, any_value(dst_id) AS dst_id, max(confidence) AS confidence FROM u GROUP BY id""")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return resolve.apply_resolutions(g, resolve.resolve(g))


@query(GRAPH + f", {_CHANGED}" + f""", t AS (SELECT s.id, CASE WHEN kind = 'method' AND {_OWNER} <> '' THEN {_OWNER} || '.' || name ELSE name END AS ref FROM s JOIN c USING (repo_id, path)),
i AS (SELECT e.*, t.ref FROM e JOIN t ON t.id = e.dst_id WHERE e.kind IN {REFS}),
b AS (SELECT repo_id, kind, src_id, 'symref:' || split_part(src_id, ':', 2) || ':' || split_part(src_id, ':', 3) || ':' || ref AS dst_id FROM i)
SELECT DISTINCT 'e:' || repo_id || ':' || src_id || ':' || kind || ':' || dst_id AS id FROM b
UNION ALL SELECT id FROM e WHERE id NOT IN (SELECT id FROM i)""")
def revert_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return resolve.revert_into(g, changed_files(g)).select("id")


@query("SELECT id, max(confidence) AS confidence, count(*)::BIGINT AS n_rows FROM edges GROUP BY 1")
def edge_upsert_max(spark: SparkSession, d: str) -> DataFrame:
    (edges,) = driver_tables(spark, d, "edges")
    return upsert.merge_greatest(edges, ["id"], "confidence")


@query(GRAPH + "SELECT id, confidence FROM e")
def edge_upsert_last(spark: SparkSession, d: str) -> DataFrame:
    (edges,) = driver_tables(spark, d, "edges")
    cut = edges.agg(F.percentile_approx("indexed_at", 0.5)).scalar()
    old, new = latest(edges.where(F.col("indexed_at") < cut), ["id"], "indexed_at").select(*edges.columns), edges.where(F.col("indexed_at") >= cut)
    return upsert.merge_last(old, new, ["id"], "indexed_at").select("id", "confidence")


@query(GRAPH + f", {_CHANGED}, gone AS (SELECT s.id FROM s JOIN c USING (repo_id, path)) SELECT id FROM e WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)")
def remove_paths(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return upsert.remove_paths(g, changed_files(g)).edges.select("id")


@query(GRAPH + ", h AS (SELECT repo_id, count(*) AS n FROM f GROUP BY 1) SELECT id FROM s WHERE repo_id NOT IN (SELECT repo_id FROM h ORDER BY n DESC, repo_id LIMIT 1)")
def clear_repo(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    largest = g.files.groupBy("repo_id").count().orderBy(F.desc("count"), "repo_id").limit(1).select("repo_id")
    return upsert.clear_repos(g, largest).symbols.select("id")


# evolution -------------------------------------------------------------------------------------------------------------


def commits_of(spark: SparkSession, d: str) -> DataFrame:
    """An indexing day of a repository stands for a commit that touches the files indexed in it."""
    (files,) = driver_tables(spark, d, "files")
    return files.select(F.concat_ws("@", "repo_id", F.date_format("indexed_at", "yyyy-MM-dd")).alias("commit_id"), F.col("id").alias("file"))


_FILE_PATH = "regexp_extract(file, '^file:[^:]*:(.*)$', 1)"
_COMMITS = "commits AS (SELECT repo_id || '@' || strftime(indexed_at, '%Y-%m-%d') AS commit_id, id AS file FROM files)"
_CENT = "cent AS (SELECT 'file:' || s.repo_id || ':' || s.path AS file, count(*)::BIGINT AS degree FROM e JOIN s ON s.id = e.dst_id WHERE e.kind = 'calls' GROUP BY 1)"


def centrality_of(g: graph.Graph) -> DataFrame:
    into = g.edges.where("kind = 'calls'").select(F.col("dst_id").alias("id"))
    return into.join(g.symbols.select("id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("file")), "id").groupBy("file").agg(F.count("*").alias("degree"))


@query(f"WITH {_COMMITS} SELECT file, count(DISTINCT commit_id)::BIGINT AS n_commits FROM commits GROUP BY 1")
def churn(spark: SparkSession, d: str) -> DataFrame:
    return evolve.churn(commits_of(spark, d))


@query(GRAPH + f""", {_COMMITS}, {_CENT}, ok AS (SELECT id FROM files WHERE """ + " AND ".join(f"NOT {matches('path', p)}" for p in (paths.HOTSPOT_NOISE, paths.TEST, paths.SECONDARY, paths.ADDON)) + f"""),
ch AS (SELECT file, count(DISTINCT commit_id) AS n FROM commits WHERE file IN (SELECT id FROM ok) GROUP BY 1),
cent0 AS (SELECT * FROM cent WHERE """ + " AND ".join(f"NOT {matches(_FILE_PATH, p)}" for p in (paths.HOTSPOT_NOISE, paths.TEST, paths.SECONDARY, paths.ADDON)) + f"""),
h AS (SELECT file, round(ln(1 + n) / (SELECT ln(1 + max(n)) FROM ch) * ln(1 + degree) / (SELECT ln(1 + max(degree)) FROM cent0), 6) AS score FROM ch JOIN cent0 USING (file)),
t AS (SELECT * FROM h WHERE score > 0 ORDER BY score DESC, file LIMIT 20)
SELECT file, score, row_number() OVER (ORDER BY score DESC, file)::INT AS rank FROM t""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("file", "^file:[^:]*:(.*)$", 1)
    (files,) = driver_tables(spark, d, "files")
    ok = evolve.without_noise(files, F.col("path")).select(F.col("id").alias("file")).distinct()
    return evolve.hotspots(evolve.churn(commits_of(spark, d)).join(ok, "file", "left_semi"), evolve.without_noise(centrality_of(graph.load_graph(spark, d)), path))


@query(GRAPH + f", {_CENT} SELECT file, round(degree / (SELECT max(degree) FROM cent), 6) AS score FROM cent ORDER BY score DESC, file LIMIT 20")
def centrality_only(spark: SparkSession, d: str) -> DataFrame:
    return evolve.centrality_only(centrality_of(graph.load_graph(spark, d)))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS commit_id, p_name AS file FROM lineitem JOIN part ON l_partkey = p_partkey), z AS (SELECT commit_id FROM k GROUP BY 1 HAVING count(*) <= 5), c AS (SELECT * FROM k JOIN z USING (commit_id)),
t AS (SELECT file, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.file, b.file AS other, count(*)::BIGINT AS support FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.file <> b.file GROUP BY ALL HAVING count(*) >= 20)
SELECT p.file, other, support, round(support / n, 6) AS confidence FROM p JOIN t ON t.file = p.file WHERE round(support / n, 6) >= 0.048""")
def cochange(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts that are ordered together, orders of more than five names left out."""
    lineitem, part = driver_tables(spark, d, "lineitem", "part")
    c = lineitem.select("l_orderkey", "l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return evolve.cochange(c.select(F.col("l_orderkey").alias("commit_id"), F.col("p_name").alias("file")), 5, 20, 0.048)
