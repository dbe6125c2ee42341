"""Queries over stores that are changed in place, checks of changes, and what an index has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import bundle, freshness, gates, graph, review, rules, search, traverse
from codeloom.operators.current import latest
from codeloom.operators.stores import KeyedTable, hub_artifact, table_statistics
from codeloom.plans.base import GRAPH, ORACLES, latest_sql, query
from codeloom.plans.graph_queries import _CHANGED, _UP, REFS, _bfs, changed_files, dirname_sql, matches
from codeloom.plans.ranking_queries import HYBRID
from codeloom.plans.search_queries import SYMBOL_QUERIES, sample_lines
from codeloom.runtime import driver_tables, work_area

# tables changed in place ---------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, name: str, keys: list[str], by: list[str] | None = None) -> KeyedTable:
    return KeyedTable(spark, work_area(spark, name).root, keys, by, buckets=8)


@query("SELECT id, arg_max(status, created_at) AS status, arg_max(confidence, created_at) AS confidence FROM ch_runs GROUP BY 1")
def stored_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs inserted, then those of the newest half inserted again with the rest of their rows."""
    (runs,) = driver_tables(spark, d, "ch_runs")
    rows = runs.select("id", "status", "confidence", "created_at")
    cut = rows.agg(F.percentile_approx("created_at", 0.5)).scalar()
    t = _table(spark, "runs", ["id"])
    t.upsert(rows.where(F.col("created_at") <= cut), "created_at")
    t.upsert(rows.where(F.col("created_at") > cut), "created_at")
    return t.read().select("id", "status", "confidence")


@query("SELECT tool_name, count(*)::BIGINT AS n FROM ch_tool_calls WHERE id IS NOT NULL GROUP BY 1")
def stored_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls appended in two batches; no row is dropped or merged."""
    (calls,) = driver_tables(spark, d, "ch_tool_calls")
    rows = calls.select("id", "tool_name", "step_index")
    t = _table(spark, "calls", ["id"])
    t.append(rows.where("step_index < 3"))
    t.append(rows.where("step_index >= 3 OR step_index IS NULL"))
    return t.read().groupBy("tool_name").agg(F.count("*").alias("n"))


@query(f"SELECT run_id, id, step_index FROM ({latest_sql('ch_tool_calls', 'logged_at')}) WHERE run_id IN (SELECT id FROM ch_runs WHERE status = 'failed')")
def calls_of_failed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records by run: the calls of every failed run."""
    runs, calls = driver_tables(spark, d, "ch_runs", "ch_tool_calls")
    failed = runs.where("status = 'failed'").select(F.col("id").alias("run_id"))
    return latest(calls, ["id"], "logged_at", ["run_id", "step_index"]).join(failed, "run_id", "left_semi").select("run_id", "id", "step_index")


@query(f"SELECT id, hash FROM ({latest_sql('files', 'indexed_at')}) WHERE language IS NOT NULL")
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """File hashes put by file, last write wins; those of files without a language deleted again."""
    (files,) = driver_tables(spark, d, "files")
    t = _table(spark, "hashes", ["id"])
    t.upsert(files.select("id", "hash", "language", "indexed_at"), "indexed_at")
    t.delete(t.read().where("language IS NULL").select("id"))
    return t.read().select("id", "hash")


_CLUSTERS = "SELECT repo_id, 'kind:' || kind AS name, count(*)::BIGINT AS n_members FROM s GROUP BY ALL"


@query(GRAPH + f""", {_CHANGED}, old AS ({_CLUSTERS}), new AS (SELECT repo_id, 'language:' || coalesce(language, 'none') AS name, count(*)::BIGINT AS n_members FROM s GROUP BY ALL)
SELECT * FROM old WHERE repo_id NOT IN (SELECT repo_id FROM c) AND name <> 'kind:unknown' UNION ALL SELECT * FROM new WHERE repo_id IN (SELECT repo_id FROM c)""")
def stored_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all repositories; those of changed repositories replaced as a whole, then one name deleted everywhere."""
    g = graph.load_graph(spark, d)
    old = g.symbols.groupBy("repo_id", F.concat(F.lit("kind:"), "kind").alias("name")).agg(F.count("*").alias("n_members"))
    new = g.symbols.groupBy("repo_id", F.concat(F.lit("language:"), F.coalesce("language", F.lit("none"))).alias("name")).agg(F.count("*").alias("n_members"))
    t = _table(spark, "clusters", ["repo_id", "name"], ["repo_id"])
    t.upsert(old)
    t.replace(new, changed_files(g).select("repo_id").distinct())
    t.delete(spark.createDataFrame([("kind:unknown",)], "name string"))
    return t.read().select("repo_id", "name", "n_members")


@query(GRAPH + f""", a AS (SELECT s.repo_id, dst_id AS id, count(*)::BIGINT AS n FROM e JOIN s ON s.id = e.dst_id WHERE e.kind = 'calls' GROUP BY ALL),
p AS (SELECT id, repo_id, {dirname_sql('path')} AS dir FROM s), b AS (SELECT y.repo_id, y.dir AS id, count(*)::BIGINT AS n FROM e JOIN p x ON x.id = e.src_id JOIN p y ON y.id = e.dst_id WHERE e.kind = 'calls' AND x.repo_id = y.repo_id AND x.dir <> y.dir GROUP BY ALL),
r AS (SELECT repo_id, 'symbol' AS what, id, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, id)::INT AS place FROM a), q AS (SELECT repo_id, 'package' AS what, id, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, id)::INT AS place FROM b)
SELECT * FROM r WHERE place <= 8 UNION ALL SELECT * FROM q WHERE place <= 6""")
def hub_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the most-called symbols, and the folders most called from other folders."""
    g = graph.load_graph(spark, d)
    calls = g.edges.where("kind = 'calls'").select("src_id", "dst_id")
    p = g.symbols.select("id", "repo_id", paths.dirname(F.col("path")).alias("dir"))
    into = calls.join(p.select(F.col("id").alias("dst_id"), "repo_id", "dir"), "dst_id")
    symbols = into.groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.count("*").alias("n"))
    both = into.join(p.select(F.col("id").alias("src_id"), F.col("repo_id").alias("from_repo"), F.col("dir").alias("from_dir")), "src_id")
    packages = both.where("repo_id = from_repo AND dir <> from_dir").groupBy("repo_id", F.col("dir").alias("id")).agg(F.count("*").alias("n"))
    return hub_artifact(symbols, packages)


@query(GRAPH + ", n AS (SELECT repo_id, name, count(*)::BIGINT AS n FROM s WHERE name IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, name)::INT AS place FROM n) SELECT * FROM r WHERE place <= 20")
def vocabulary_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty commonest names of each repository."""
    s = graph.load_graph(spark, d).symbols.where("name IS NOT NULL")
    n = s.groupBy("repo_id", "name").agg(F.count("*").alias("n")).withColumn("query_id", F.col("repo_id"))
    return search.top(n, 20, ("name",), "n").select("repo_id", "name", "n", F.col("rank").alias("place"))


_STATS = (("files", "id"), ("symbols", "id"), ("edges", "dst_id"), ("ch_tool_calls", "run_id"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n_rows, count(DISTINCT {k})::BIGINT AS n_keys, (count(*) FILTER ({k} IS NULL))::BIGINT AS n_null_keys FROM {t}" for t, k in _STATS))
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    whole = None
    for t, k in _STATS:
        (rows,) = driver_tables(spark, d, t)
        one = table_statistics(rows.select(k), k).select(F.lit(t).alias("name"), "*")
        whole = one if whole is None else whole.unionByName(one)
    return whole


# checks of changes ----------------------------------------------------------------------------------------------------------

_REPO = "regexp_extract(file, '^file:([^:]*):', 1)"
_PATH = "regexp_extract(file, '^file:[^:]*:(.*)$', 1)"


def security_findings(spark: SparkSession, d: str) -> DataFrame:
    f = rules.scan_lines(sample_lines(spark, d), rules.SECURITY_RULES)
    return f.select(F.regexp_extract("file", "^file:([^:]*):", 1).alias("repo_id"), F.regexp_extract("file", "^file:[^:]*:(.*)$", 1).alias("path"), "line", "rule", "severity")


@query(GRAPH + f""", {_CHANGED}, x AS (SELECT {_REPO} AS repo_id, {_PATH} AS path, line, rule FROM ({ORACLES["config_scan"]})), b AS (SELECT DISTINCT repo_id, regexp_extract(replace(path, chr(92), '/'), '[^/]*$') AS seg FROM c)
SELECT x.repo_id, x.path, line, rule, CASE WHEN (x.repo_id, x.path) IN (SELECT repo_id, path FROM c) THEN 0 WHEN EXISTS (SELECT 1 FROM b WHERE b.repo_id = x.repo_id AND list_contains(string_split(replace(x.path, chr(92), '/'), '/'), b.seg)) THEN 1 ELSE 2 END::INT AS distance FROM x""")
def finding_distances(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.plans.tool_queries import SAMPLE_RULES

    f = rules.scan_lines(sample_lines(spark, d), SAMPLE_RULES, comments=True)
    f = f.select(F.regexp_extract("file", "^file:([^:]*):", 1).alias("repo_id"), F.regexp_extract("file", "^file:[^:]*:(.*)$", 1).alias("path"), "line", "rule")
    return gates.finding_distance(f, changed_files(graph.load_graph(spark, d)))


@query(GRAPH + f", {_CHANGED} SELECT repo_id, count(DISTINCT path)::BIGINT AS n_files, count(DISTINCT path) <= 5 AS within FROM c GROUP BY 1")
def change_budgets(spark: SparkSession, d: str) -> DataFrame:
    return gates.change_budget(changed_files(graph.load_graph(spark, d)), 5)


@query(GRAPH + f""", x AS (SELECT {_REPO} AS repo_id, severity FROM ({ORACLES["security_scan"]})), k AS (SELECT s.repo_id FROM s JOIN ({ORACLES["contract_guard"]}) p USING (id) WHERE s.kind = 'interface'),
t AS (SELECT s.repo_id FROM s JOIN ({ORACLES["test_gap"]}) p USING (id)), q AS (SELECT DISTINCT repo_id FROM f),
n AS (SELECT repo_id, (SELECT count(*) FROM x WHERE x.repo_id = q.repo_id AND severity IN ('critical','high','medium'))::BIGINT AS n_blocking, (SELECT count(*) FROM k WHERE k.repo_id = q.repo_id)::BIGINT AS n_breaking, (SELECT count(*) FROM t WHERE t.repo_id = q.repo_id)::BIGINT AS n_gaps FROM q)
SELECT *, n_blocking = 0 AND n_breaking = 0 AS ship, concat_ws('; ', CASE WHEN n_blocking > 0 OR n_breaking > 0 THEN 'resolve blocking findings' END, CASE WHEN n_gaps > 0 THEN 'add tests for changed symbols' END) AS required FROM n""")
def release_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Review of every repository: findings, changed public interfaces and symbols without tests, rolled up."""
    g = graph.load_graph(spark, d)
    c = changed_files(g)
    of = g.symbols.select("id", "repo_id", "kind")
    public = review.contract_guard(g, c).select("id").join(of, "id").where("kind = 'interface'")
    gaps = review.test_gap(g, c).select("id").join(of, "id")
    return gates.readiness(g.files, security_findings(spark, d), public, gaps, ("critical", "high", "medium"))


@query(GRAPH + f", n AS (SELECT s.repo_id, s.id, count(DISTINCT e.src_id) AS n FROM e JOIN s ON s.id = e.dst_id WHERE e.kind IN {REFS} GROUP BY ALL), t AS (SELECT repo_id, CASE WHEN n > 40 THEN 3 WHEN n > 10 THEN 2 ELSE 1 END AS k FROM n) SELECT repo_id, ['low','medium','high'][max(k)] AS risk FROM t GROUP BY 1")
def repository_risks(spark: SparkSession, d: str) -> DataFrame:
    """The worst tier of callers among the symbols of each repository."""
    g = graph.load_graph(spark, d)
    e = g.edges.where(F.col("kind").isin(graph.REFERENCES)).select("src_id", F.col("dst_id").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    t = e.join(g.symbols.select("id", "repo_id"), "id").select("repo_id", traverse.risk_tier(F.col("n")).alias("risk"))
    return gates.worst_risk(t, "repo_id")


SURFACES = (("framework", gates.SURFACES[0][1]), ("app", gates.SURFACES[1][1] + r"|(^|/)(routing|inbox)[0-9]+/"), ("manifest", r"(^|/)(package-lock\.json|yarn\.lock|go\.sum)$"))
_KIND = " ".join(f"WHEN {k} > 0 THEN '{k}'" for k, _ in SURFACES)


@query(GRAPH + f""", n AS (SELECT repo_id, count(*) FILTER ({matches('path', '[.](c|cc|cpp)$')}) AS n_native, {", ".join(f"count(*) FILTER ({matches('path', p)}) AS {k}" for k, p in SURFACES)} FROM f GROUP BY 1),
k AS (SELECT repo_id, CASE WHEN n_native >= 3 AND framework = 0 AND app = 0 THEN 'non_http' {_KIND} ELSE 'unknown' END AS kind FROM n) SELECT repo_id, kind, kind NOT IN ('unknown', 'non_http') AS capable FROM k""")
def http_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return gates.http_surface(graph.load_graph(spark, d).files, SURFACES, 3)


#: rule, shape of the repository, pattern of the path that the hint is anchored in.
HINTS = (("perf-cache", "app", r"cache"), ("perf-index", "library", r"index"), ("security-auth", "app", r"auth|session"), ("security-parse", "library", r"decode|parse"))


@query(GRAPH + f""", p AS (SELECT repo_id, shape FROM ({ORACLES["project_shapes"]})), h AS ({" UNION ALL ".join(f"SELECT DISTINCT f.repo_id, '{r}' AS rule, path FROM f JOIN p USING (repo_id) WHERE shape = '{s}' AND {matches('path', x)}" for r, s, x in HINTS)}),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, rule ORDER BY path)::INT AS place FROM h) SELECT * FROM o WHERE place <= 3""")
def guidance_hints(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.plans.tool_queries import project_shapes

    return gates.guidance(graph.load_graph(spark, d).files, project_shapes(spark, d).select("repo_id", "shape"), HINTS)


_RUNS = "r AS (SELECT DISTINCT id, task, workflow, confidence FROM ch_runs)"


@query(f"""WITH {_RUNS}, x AS (SELECT *, lower(coalesce(task, '')) AS low, length(coalesce(task, '')) < 110 AS short, len(regexp_extract_all(coalesce(task, ''), '[a-z]+-[a-z0-9-]+')) AS ents, coalesce(confidence, 0) AS sure FROM r)
SELECT id, CASE WHEN sure < 0.72 OR ents > 6 OR regexp_matches(low, 'entire codebase|whole repo|all packages|across the project|major refactor') THEN 'deep' WHEN workflow IN ('review','dead_code','perf','security') THEN CASE WHEN sure >= 0.85 AND short THEN 'standard' ELSE 'deep' END
  WHEN sure >= 0.85 AND short AND ents <= 2 AND workflow IN ('explain','feature','bugfix','refactor') THEN 'fast' WHEN workflow = 'explain' THEN 'fast' WHEN workflow = 'feature' AND sure >= 0.88 AND ents <= 3 THEN 'fast' ELSE 'standard' END AS tier FROM x""")
def task_tiers(spark: SparkSession, d: str) -> DataFrame:
    (runs,) = driver_tables(spark, d, "ch_runs")
    r = runs.select("id", "task", "workflow", "confidence").distinct()
    entities = F.size(F.regexp_extract_all(F.coalesce("task", F.lit("")), F.lit("([a-z]+-[a-z0-9-]+)"), 1))
    return r.select("id", gates.task_tier(F.col("task"), F.col("confidence"), entities, F.col("workflow")).alias("tier"))


NEEDS = (("storage", "check the schema"), ("storage", "bound the rows read"), ("code", "keep public names"), ("code", "add a test"))


@query(f"""WITH n(pattern, requirement) AS (VALUES {", ".join(f"('{p}', '{r}')" for p, r in NEEDS)}), p AS (SELECT id, pattern FROM ({ORACLES["pattern_select"]})), r AS (SELECT DISTINCT id FROM ch_runs),
w AS (SELECT pattern, array_to_string(list_sort(list(DISTINCT requirement)), '|') AS requirements FROM n GROUP BY 1), j AS (SELECT r.id, coalesce(p.pattern, 'code') AS pattern FROM r LEFT JOIN p USING (id))
SELECT id, pattern, coalesce(requirements, '') AS requirements FROM j LEFT JOIN w USING (pattern)""")
def expanded_requests(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.plans.review_queries import pattern_select

    (runs,) = driver_tables(spark, d, "ch_runs")
    needs = spark.createDataFrame(list(NEEDS), "pattern string, requirement string")
    r = gates.expanded_requests(runs.select("id").distinct(), pattern_select(spark, d), needs, "code")
    return r.select("id", "pattern", F.array_join("requirements", "|").alias("requirements"))


_MODULE = "regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1)"


@query(GRAPH + f", m AS (SELECT DISTINCT {_MODULE} AS module FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%') SELECT module, contains(module, '/') AND NOT regexp_matches(module, '^[@#~/]') AND NOT contains(module, chr(92)) AND NOT contains(module, '://') AND NOT contains(split_part(module, '/', 1), '.') AS rooted FROM m")
def rooted_imports(spark: SparkSession, d: str) -> DataFrame:
    m = graph.load_graph(spark, d).edges.where("kind = 'imports' AND dst_id LIKE 'mod:%'").select(F.regexp_extract("dst_id", "^mod:[^:]*:(.*)$", 1).alias("module")).distinct()
    return m.select("module", gates.repo_rooted(F.col("module")).alias("rooted"))


@query(GRAPH + ", a AS (SELECT name FROM s GROUP BY 1 HAVING count(*) > 1), c AS (SELECT name, id, path, starts_with(lower(name), 's') AND contains(path, 'packages/') AS fits FROM s JOIN a USING (name)), t AS (SELECT name, bool_or(coalesce(fits, false)) AS any_fits FROM c GROUP BY 1) SELECT c.name, id, path FROM c JOIN t USING (name) WHERE NOT any_fits OR fits")
def hinted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of ambiguous names, those that a hint (names with s live in packages) fits first."""
    s = graph.load_graph(spark, d).symbols
    many = s.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    c = s.join(many.select("name"), "name", "left_semi").select("name", "id", "path")
    hints = many.where("lower(name) LIKE 's%'").select("name", F.lit("packages/").alias("hint"))
    return gates.prefer_hinted(c, hints)


# what an index has to do ----------------------------------------------------------------------------------------------------


@query(GRAPH + f", {_CHANGED}, n AS (SELECT repo_id, count(DISTINCT path)::BIGINT AS n_files FROM f GROUP BY 1), k AS (SELECT repo_id, count(DISTINCT path)::BIGINT AS n_changed FROM c GROUP BY 1), j AS (SELECT repo_id, n_files, coalesce(n_changed, 0) AS n_changed FROM n LEFT JOIN k USING (repo_id)) SELECT *, CASE WHEN n_changed = 0 THEN 'none' WHEN n_changed > 0.5 * n_files THEN 'full' ELSE 'incremental' END AS mode FROM j")
def index_plans(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return freshness.index_plan(g.files.where("path IS NOT NULL"), changed_files(g))


@query(GRAPH + f", {_CHANGED} SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path)::INT AS place FROM (SELECT DISTINCT repo_id, path FROM c)")
def index_order(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return freshness.stable_order(changed_files(g), g.files)


@query("""WITH i AS (SELECT repo_id, max(indexed_at) AS indexed_at FROM files GROUP BY 1), h AS (SELECT DISTINCT repo_id FROM symbols WHERE repo_id IS NOT NULL), x AS (SELECT repo_id, max(indexed_at) AS edited_at FROM symbols GROUP BY 1),
r AS (SELECT repo_id, CASE WHEN indexed_at IS NULL THEN 'no index' WHEN length(repo_id) % 5 = 0 THEN 'head moved' WHEN edited_at > indexed_at THEN 'files changed' END AS reason FROM h LEFT JOIN i USING (repo_id) LEFT JOIN x USING (repo_id)) SELECT repo_id, reason IS NOT NULL AS stale, reason FROM r""")
def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Repositories whose symbols are newer than their files; heads are made from names (each fifth length has moved on)."""
    files, symbols = driver_tables(spark, d, "files", "symbols")
    indexed = freshness.newest_change(files, "indexed_at").select("repo_id", F.lit("0").alias("commit"), F.lit("1").alias("version"), F.col("edited_at").alias("indexed_at"))
    heads = symbols.where("repo_id IS NOT NULL").select("repo_id", F.when(F.length("repo_id") % 5 == 0, "1").otherwise("0").alias("head")).distinct()
    return freshness.freshness(indexed, heads, freshness.newest_change(symbols, "indexed_at"), "1")


@query("""WITH p AS (SELECT DISTINCT user_id::VARCHAR AS source, json_extract_string(props, '$.k') AS path FROM events WHERE event_type IN ('view', 'purchase')), o AS (SELECT DISTINCT user_id::VARCHAR AS source FROM events WHERE event_type = 'error' AND value > 95),
a AS (SELECT DISTINCT user_id::VARCHAR AS source, json_extract_string(props, '$.k') AS path FROM events)
SELECT DISTINCT source, path FROM (SELECT * FROM p WHERE source NOT IN (SELECT source FROM o) AND path <> '' UNION ALL SELECT a.* FROM a JOIN o USING (source) WHERE path IS NOT NULL)""")
def pending_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that wait by source, relevant operations only; all paths of sources that lost events."""
    (events,) = driver_tables(spark, d, "events")
    e = events.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("op"), F.get_json_object("props", "$.k").alias("path"), "value")
    waiting = freshness.intake(e, ["view", "purchase"])
    lost = e.where("op = 'error' AND value > 95").select("source", F.lit(freshness.OVERFLOW).alias("path"))
    return freshness.resync(freshness.requeue(waiting, lost), e.where("path IS NOT NULL").select("source", "path"))


# several operators at once -----------------------------------------------------------------------------------------------------


@query(GRAPH + f", h AS (SELECT * FROM {HYBRID} WHERE rank <= 5)" + _bfs(_UP, "SELECT DISTINCT id AS seed, id AS node FROM h", 4) + f""", n AS (SELECT seed AS id, count(*)::BIGINT AS n_impacted FROM r WHERE depth > 0 GROUP BY 1),
k AS (SELECT e.dst_id AS id, count(DISTINCT e.src_id)::BIGINT AS n_callers FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN {REFS} GROUP BY 1)
SELECT query_id, h.id, rank, coalesce(n_callers, 0) AS n_callers, coalesce(n_impacted, 0) AS n_impacted FROM h LEFT JOIN k USING (id) LEFT JOIN n USING (id)""")
def scout(spark: SparkSession, d: str) -> DataFrame:
    """The five best symbols of each stated query with their callers and what a change would reach in four steps."""
    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES, k=5)
    hits = work_area(spark, "scout").put(hits.select("query_id", "id", "rank"), "hits")
    reached = traverse.impact(g, hits.select(F.col("id").alias("seed")).distinct(), 4).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("n_impacted"))
    callers = graph.callers(g).join(hits.select(F.col("id").alias("callee")), "callee", "left_semi").groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("n_callers"))
    return hits.join(callers, "id", "left").join(reached, "id", "left").na.fill(0, ["n_callers", "n_impacted"]).select("query_id", "id", "rank", "n_callers", "n_impacted")


@query(f"SELECT query_id, b.* FROM ({ORACLES['context_bundle']}) b JOIN {HYBRID} h USING (id) WHERE rank = 1")
def investigate(spark: SparkSession, d: str) -> DataFrame:
    """The best symbol of each stated query with its bounded context."""
    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES, k=1).select("query_id", "id")
    b = bundle.context_bundles(g, is_test=F.col("src_name").rlike("^(check|verify)"))
    return hits.join(b, "id").select("query_id", "id", *[F.array_join(c, "|").alias(c) for c in ("callers", "callees", "imports", "tests")])


_RISK = f"CASE WHEN regexp_matches(lower(path), '{paths.MONEY}') THEN 'money' WHEN regexp_matches(lower(path), '{paths.AUTH}') THEN 'auth' ELSE 'behaviour' END"


@query(GRAPH + f", h AS (SELECT * FROM {HYBRID} WHERE rank <= 4) SELECT query_id, h.id, rank, {_RISK} AS domain FROM h JOIN s USING (id)")
def scope(spark: SparkSession, d: str) -> DataFrame:
    """Where the four best symbols of each stated query lie."""
    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES, k=4)
    return hits.join(g.symbols.select("id", "path"), "id").select("query_id", "id", "rank", paths.test_risk(F.col("path")).alias("domain"))
