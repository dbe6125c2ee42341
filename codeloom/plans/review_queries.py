"""Queries over changed code, name disambiguation, packs and self-retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import docs, evaluate, graph, markdown, review, rules, search
from codeloom.plans.base import GRAPH, query
from codeloom.plans.graph_queries import _CHANGED, _EXPORTED, REFS, changed_files, matches
from codeloom.plans.search_queries import _LINES, _scan, _words, _STATEMENT_ENDS, sample_lines, sample_lines_sql
from codeloom.runtime import driver_tables

_STEM = "regexp_replace(path, '\\.[^./]*$', '')"
_EXT = "'.' || regexp_extract(path, '[^.]*$')"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' ELSE '' END"
_NAME = f"regexp_extract({_STEM}, '[^/]*$')"
_TESTED = f"""tested AS (SELECT DISTINCT repo_id, path FROM (SELECT repo_id, path, unnest([{_STEM} || '_test' || {_EXT}, {_STEM} || '.test' || {_EXT}, {_STEM} || '.spec' || {_EXT}, {_DIR} || 'test_' || {_NAME} || {_EXT}, {_DIR} || 'tests/test_' || {_NAME} || {_EXT}, {_DIR} || '__tests__/' || {_NAME} || '.test' || {_EXT}]) AS test FROM f) x WHERE (repo_id, test) IN (SELECT repo_id, path FROM f))"""


@query(GRAPH + f", {_CHANGED}, {_TESTED}" + f"""
SELECT s.id, s.name, s.path, CASE WHEN regexp_matches(lower(s.path), '{paths.MONEY}') THEN 'money' WHEN regexp_matches(lower(s.path), '{paths.AUTH}') THEN 'auth' ELSE 'behaviour' END AS risk
FROM s JOIN c USING (repo_id, path) WHERE s.kind IN ('function','method') AND NOT {matches('s.path', paths.TEST)} AND (s.repo_id, s.path) NOT IN (SELECT repo_id, path FROM tested)""")
def test_gap(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return review.test_gap(g, changed_files(g))


@query(GRAPH + f", {_CHANGED} SELECT s.id, s.name, s.path FROM s JOIN c USING (repo_id, path) WHERE ({_EXPORTED} OR regexp_matches(lower(path), '(^|/)(pkg|cmd|api)/')) AND NOT regexp_matches(lower(path), '(^|/)(internal|private)/')")
def contract_guard(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return review.contract_guard(g, changed_files(g))


#: Layers by the folders that the tables have.
TABLE_FOLDERS = {"model": r"(^|/)(vault|ledger|registry)[0-9]*/", "view": r"(^|/)(render|profile|alerts)[0-9]*/", "api": r"(^|/)(routing|auth|relay)[0-9]*/"}
_LAYER = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{k}'" for k, p in TABLE_FOLDERS.items()) + " ELSE 'other' END"


@query(GRAPH + f", l AS (SELECT id, {_LAYER} AS layer FROM s) SELECT e.src_id, e.dst_id, a.layer AS src_layer, b.layer AS dst_layer FROM e JOIN l a ON a.id = e.src_id JOIN l b ON b.id = e.dst_id WHERE e.kind = 'calls' AND (" + " OR ".join(f"(a.layer = '{a}' AND b.layer = '{b}')" for a, b in review.FORBIDDEN) + ")")
def architecture_lint(spark: SparkSession, d: str) -> DataFrame:
    return review.architecture_lint(graph.load_graph(spark, d), TABLE_FOLDERS).select("src_id", "dst_id", "src_layer", "dst_layer")


@query(GRAPH + f"""
, fan AS (SELECT dst_id AS id, count(DISTINCT src_id) AS n FROM e WHERE kind IN {REFS} GROUP BY 1),
x AS (SELECT s.id, s.name, {matches('s.path', paths.FIXTURE)} AS fixture, coalesce(fan.n, 0) AS fan_in FROM s LEFT JOIN fan USING (id)),
y AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, count(*) FILTER (NOT fixture) OVER (PARTITION BY name) AS n_own, lead(fan_in) OVER (PARTITION BY name ORDER BY fan_in DESC, id) AS nxt, row_number() OVER (PARTITION BY name ORDER BY fan_in DESC, id) AS r FROM x),
z AS (SELECT name, id, CASE WHEN n = 1 THEN 'only' WHEN n_own = 1 AND NOT fixture THEN 'non_fixture' WHEN n_own <> 1 AND r = 1 AND fan_in > 0 AND fan_in >= coalesce(nxt, 0) * 2 THEN 'fan_in' END AS how FROM y)
SELECT * FROM z WHERE how IS NOT NULL""")
def disambiguate(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return review.disambiguate(g, g.symbols.select("name"))


@query(GRAPH + f"""
, i AS (SELECT DISTINCT repo_id, regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1) AS module FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%'),
roots AS (SELECT DISTINCT repo_id AS owner, split_part(regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1), '/', 1) AS root FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%'),
h AS (SELECT i.repo_id, i.module, owner, length(root) AS n FROM i JOIN roots ON lower(split_part(i.module, '/', 1)) = lower(root) AND owner <> i.repo_id)
SELECT repo_id, module, arg_max(owner, (n, owner)) AS owner FROM h GROUP BY ALL""")
def cross_repo_owners(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that import from the same root, as owners of each other's imports."""
    g = graph.load_graph(spark, d)
    imports = graph.distinct_imports(g)
    raw = g.edges.where("kind = 'imports' AND dst_id LIKE 'mod:%'").select("repo_id", F.regexp_extract("dst_id", r"^mod:[^:]*:(.*)$", 1).alias("module")).distinct()
    roots = raw.select(F.col("repo_id").alias("owner"), F.substring_index("module", "/", 1).alias("root")).distinct()
    return graph.resolve_owners(imports, roots)


@query(GRAPH + """
, p AS (SELECT DISTINCT repo_id, path, line_start + 3 AS line FROM s WHERE kind = 'method'),
c AS (SELECT p.repo_id, p.path, p.line, s.id, s.line_end >= p.line AS inside, CASE WHEN s.line_end >= p.line THEN s.line_end - s.line_start ELSE p.line - s.line_start END AS far FROM p JOIN s ON s.repo_id = p.repo_id AND s.path = p.path AND s.line_start <= p.line)
SELECT repo_id, path, line, arg_min(id, (CASE WHEN inside THEN 0 ELSE 1 END, far, id)) AS symbol_id, bool_or(inside) AS inside FROM c GROUP BY ALL""")
def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    places = s.where("kind = 'method'").select("repo_id", "path", (F.col("line_start") + 3).alias("line")).distinct()
    return graph.enclosing_symbols(s, places)


# Words that tell what a task wants.
TASKS = {"bugfix": ["fix", "repair", "bug"], "build": ["build", "add", "create"], "review": ["review", "check"], "refactor": ["split", "merge", "rename", "move"]}
PATTERNS = {"storage": ["ledger", "journal", "store"], "search": ["index", "search", "filter"], "flow": ["route", "queue", "stream"]}


def _cases(table: dict[str, list[str]], weight) -> str:
    rows = [f"({' + '.join(f'(CASE WHEN contains(t, {k!r}) THEN {weight(k)} ELSE 0 END)' for k in ks)}, {-i}, '{name}')" for i, (name, ks) in enumerate(table.items())]
    return "greatest(" + ", ".join(f"row{r}" for r in rows) + ")"


@query(f"WITH r AS (SELECT DISTINCT id, lower(coalesce(task, '')) AS t FROM ch_runs), b AS (SELECT id, {_cases(TASKS, lambda k: 1)} AS x FROM r), c AS (SELECT id, list_extract([x], 1) AS x FROM b) SELECT id, CASE WHEN struct_extract(x, 1) > 0 THEN struct_extract(x, 3) ELSE 'explain' END AS label, struct_extract(x, 1)::INT AS score FROM c")
def task_classes(spark: SparkSession, d: str) -> DataFrame:
    (runs,) = driver_tables(spark, d, "ch_runs")
    return review.classify(runs.select("id", F.col("task").alias("text")).distinct(), TASKS)


@query(f"WITH r AS (SELECT DISTINCT id, lower(coalesce(task, '')) AS t FROM ch_runs), b AS (SELECT id, {_cases(PATTERNS, len)} AS x FROM r) SELECT id, struct_extract(x, 3) AS pattern, struct_extract(x, 1)::INT AS score FROM b WHERE struct_extract(x, 1) > 0")
def pattern_select(spark: SparkSession, d: str) -> DataFrame:
    (runs,) = driver_tables(spark, d, "ch_runs")
    return review.select_pattern(runs.select("id", F.col("task").alias("text")).distinct(), PATTERNS)


#: What the samples of files have: values taken from arrays by number, and calls that read or keep them.
READ, KEPT = r"\[[0-9]+\]", (("load", r"\b(load|fetch|resolve|parse)\s*\("), ("store", r"\b(store|flush|publish|push)\s*\("))


def _sinks() -> str:
    return " UNION ALL ".join(f"SELECT file, line, '{k}' AS sink, content FROM l WHERE regexp_matches(content, '{p}')" for k, p in KEPT)


@query(f"""WITH {sample_lines_sql(_STATEMENT_ENDS)}, t AS (SELECT file, regexp_extract(content, '{review.ASSIGN}', 1) AS name, min(line) AS at FROM l WHERE regexp_matches(regexp_extract(content, '{review.ASSIGN}', 2), '{READ}') GROUP BY ALL),
k AS ({_sinks()}), w AS (SELECT DISTINCT file, line, sink, unnest(regexp_extract_all(content, '([A-Za-z_]\\w*)', 1)) AS name FROM k) SELECT w.file, w.line, w.sink, w.name FROM w JOIN t ON t.file = w.file AND t.name = w.name WHERE w.line > t.at""")
def dataflow(spark: SparkSession, d: str) -> DataFrame:
    return review.dataflow(sample_lines(spark, d, _STATEMENT_ENDS), READ, KEPT)


@query()
def context_packs(spark: SparkSession, d: str) -> DataFrame:
    """For each stated symbol query the pool of the ranked search, packed greedily into a token budget."""
    from codeloom.plans.search_queries import SYMBOL_QUERIES

    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES, k=60)
    d2 = hits.join(g.symbols.select("id", "path", "line_start", "line_end"), "id")
    n = ((F.col("line_end") - F.col("line_start") + 1) * 10).cast("bigint")
    return markdown.greedy_pack(d2.select(F.col("query_id").alias("group"), "id", "score", n.alias("n_tokens"), paths.context_kind(F.col("path")).alias("kind")), 4000)


@query(GRAPH + f"""
, w AS (SELECT repo_id, id, unnest(list_distinct({_words('name')})) AS word, len(list_distinct({_words('name')})) AS size FROM s), n AS (SELECT repo_id, word, count(*) AS df FROM w GROUP BY ALL),
u AS (SELECT repo_id, min(id) AS qid FROM s WHERE kind IN ('function','method') AND name IS NOT NULL GROUP BY repo_id, name HAVING count(*) = 1), q AS (SELECT u.repo_id, qid, word FROM u JOIN w ON w.id = qid),
r AS (SELECT qid, w.id, round(sum(1 / ln(1.0 + df)), 9) AS score, max(size) AS size FROM q JOIN w USING (repo_id, word) JOIN n USING (repo_id, word) GROUP BY ALL),
o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, size, id) AS rank FROM r), x AS (SELECT u.repo_id, u.qid, rank FROM u LEFT JOIN o ON o.qid = u.qid AND o.id = u.qid)
SELECT repo_id, count(*)::BIGINT AS n_queries, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM x GROUP BY repo_id""")
def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every function and method whose name is unique among those of its repository, searched there by its words; one row a repository."""
    return evaluate.self_retrieval(graph.load_graph(spark, d).symbols)


@query(GRAPH + """
, c AS (SELECT dst_id, count(DISTINCT src_id) AS n, count(DISTINCT split_part(src_id, ':', 3)) AS files FROM e WHERE kind = 'calls' AND dst_id LIKE 'sym:%' GROUP BY 1),
t AS (SELECT dst_id AS id, (12 * n + 20)::BIGINT AS tool_tokens, (files * 1200)::BIGINT AS read_tokens FROM c),
v AS (SELECT list_sort(list(tool_tokens)) AS a, list_sort(list(read_tokens)) AS b, count(*) AS n FROM t)
SELECT p, which, CASE which WHEN 'tool' THEN a[((n - 1) * p // 100 + 1)::BIGINT] ELSE b[((n - 1) * p // 100 + 1)::BIGINT] END AS value FROM v, (SELECT unnest([50, 95]) AS p), (SELECT unnest(['read', 'tool']) AS which)""")
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all called symbols: tokens of a caller list against reading the callers' files."""
    e = graph.load_graph(spark, d).edges.where("kind = 'calls' AND dst_id LIKE 'sym:%'")
    c = e.groupBy("dst_id").agg(F.count_distinct("src_id").alias("n"), F.count_distinct(F.get(F.split("src_id", ":"), 2)).alias("files"))
    t = c.select(F.explode(F.array(F.struct(F.lit("tool").alias("which"), (12 * F.col("n") + 20).alias("v")), F.struct(F.lit("read").alias("which"), (F.col("files") * 1200).alias("v")))).alias("x")).select("x.which", "x.v")
    return evaluate.index_percentile(t, ["which"], "v", [50, 95])


@query(GRAPH + f", {_CHANGED}, {_TESTED}, {_scan(rules.NOTE_RULES, True)}" + f""", gates AS (SELECT (SELECT count(*) FILTER (severity IN ('critical','high')) FROM x)::BIGINT AS n_severe,
  (SELECT count(*) FROM s JOIN c USING (repo_id, path) WHERE s.kind IN ('function','method') AND NOT {matches('s.path', paths.TEST)} AND (s.repo_id, s.path) NOT IN (SELECT repo_id, path FROM tested))::BIGINT AS n_gaps,
  (SELECT count(*) FROM s JOIN c USING (repo_id, path) WHERE ({_EXPORTED} OR regexp_matches(lower(path), '(^|/)(pkg|cmd|api)/')) AND NOT regexp_matches(lower(path), '(^|/)(internal|private)/'))::BIGINT AS n_public)
SELECT *, CASE WHEN n_severe > 0 THEN 'blocked' WHEN n_gaps > 0 THEN 'needs_tests' ELSE 'ready' END AS verdict FROM gates""")
def finish_check(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.plans.search_queries import findings_of

    g = graph.load_graph(spark, d)
    c = changed_files(g)
    return review.finish_check(findings_of(spark, d), review.test_gap(g, c), review.contract_guard(g, c))


@query(GRAPH + """, x AS (SELECT id, path, coalesce(language, 'none') AS language, regexp_extract(path, '[^/]*$') AS title FROM f WHERE regexp_matches(path, '^[A-Za-z0-9_./-]+$') AND NOT ends_with(path, '/'))
SELECT id, 1 AS pos, language AS section, title, path AS url, 'in ' || language AS note FROM x""")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Link lists read back: one made of each file, with a heading, a link and a note."""
    f = graph.load_graph(spark, d).files.where(F.col("path").rlike("^[A-Za-z0-9_./-]+$") & ~F.col("path").endswith("/"))
    language, title = F.coalesce("language", F.lit("none")), F.substring_index("path", "/", -1)
    text = F.concat(F.lit("## "), language, F.lit("\n- ["), title, F.lit("]("), "path", F.lit("): in "), language, F.lit("\nno link here"))
    return docs.link_index(f.select("id", text.alias("text")))



