"""Queries behind tools that combine several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import evolve, graph, rules, traverse
from codeloom.plans.base import GRAPH, query
from codeloom.plans.graph_queries import _COMMITS, _EXPORTED, REFS, _bfs, commits_of, matches
from codeloom.plans.search_queries import _ENDS, sample_lines, sample_lines_sql, _LINES, _words
from codeloom.runtime import driver_tables


@query(GRAPH + f"SELECT id, name, kind, path FROM s WHERE lower(path) LIKE 'packages/%' AND {_EXPORTED} AND NOT {matches('path', paths.TEST)} AND kind IN ('class','interface','function','enum','type_alias')")
def api_surface(spark: SparkSession, d: str) -> DataFrame:
    """Exported symbols below a path prefix."""
    s = graph.prefix_scan(graph.load_graph(spark, d).symbols, "packages/")
    s = s.where(F.coalesce(paths.is_exported(F.col("name"), F.coalesce("language", F.lit(""))), F.lit(True)) & ~paths.path_flag("test", F.col("path")))
    return s.where(F.col("kind").isin("class", "interface", "function", "enum", "type_alias")).select("id", "name", "kind", "path")


@query(GRAPH + f", w AS (SELECT id, repo_id, unnest(list_distinct({_words('name')})) AS term FROM s) SELECT term, count(*)::BIGINT AS n_symbols, count(DISTINCT repo_id)::BIGINT AS n_repos FROM w GROUP BY 1 HAVING count(DISTINCT repo_id) >= 2")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    """Words of symbol names used in two repositories or more."""
    s = graph.load_graph(spark, d).symbols
    w = s.select("repo_id", F.explode(F.array_distinct(T.split_identifier(F.col("name")))).alias("term")).groupBy("term", "repo_id").agg(F.count("*").alias("n"))
    return w.groupBy("term").agg(F.sum("n").alias("n_symbols"), F.count("*").alias("n_repos")).where("n_repos >= 2")


ASKED = ["ledg", "index", "invoices"]


@query(GRAPH + f""", w AS (SELECT unnest({_words('name')}) AS term FROM s), n AS (SELECT term, count(*) AS c FROM w GROUP BY 1), q AS (SELECT unnest({ASKED}) AS token),
h AS (SELECT token, term, c, row_number() OVER (PARTITION BY token ORDER BY c DESC, term) AS r FROM q JOIN n ON term <> token AND (contains(term, token) OR contains(token, term)) AND length(term) >= 4)
SELECT token, term, 0.35::DOUBLE AS weight FROM h WHERE r <= 4""")
def vocabulary_expansion(spark: SparkSession, d: str) -> DataFrame:
    """For each stated token up to four project terms that contain it or are contained by it, the commonest first."""
    s = graph.load_graph(spark, d).symbols
    n = s.select(F.explode(T.split_identifier(F.col("name"))).alias("term")).groupBy("term").agg(F.count("*").alias("c")).where(F.length("term") >= 4)
    hit = F.filter(F.array(*[F.lit(t) for t in ASKED]), lambda t: (t != F.col("term")) & (F.contains(F.col("term"), t) | F.contains(t, F.col("term"))))
    h = n.select("term", "c", F.explode(hit).alias("token"))
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("c"), "term"))).where("r <= 4")
    return h.select("token", "term", F.lit(0.35).alias("weight"))


_SHAPE = {"cmd": "(^|/)(cmd|bin)/", "web": r"(^|/)(routes?|controllers?|views?|components?)/|\.(vue|svelte|tsx|jsx)$", "lib": "(^|/)(lib|pkg|packages)/", "src": "(^|/)(src|app|services|core|internal)/", "test": paths.TEST}


@query(GRAPH + ", c AS (SELECT repo_id, count(*)::BIGINT AS n_files, " + ", ".join(f"(count(*) FILTER (regexp_matches(lower(path), '{p}')))::BIGINT AS n_{k}" for k, p in _SHAPE.items()) + """ FROM f GROUP BY 1)
SELECT *, CASE WHEN n_files <= 3 THEN 'skeleton' WHEN n_web > 0 OR n_cmd > 0 THEN 'app' WHEN n_lib * 2 >= n_files THEN 'library' ELSE 'app' END AS shape FROM c""")
def project_shapes(spark: SparkSession, d: str) -> DataFrame:
    f = graph.load_graph(spark, d).files
    c = f.groupBy("repo_id").agg(F.count("*").alias("n_files"), *[F.count_if(F.lower("path").rlike(p)).alias(f"n_{k}") for k, p in _SHAPE.items()])
    shape = F.when(F.col("n_files") <= 3, "skeleton").when((F.col("n_web") > 0) | (F.col("n_cmd") > 0), "app").when(F.col("n_lib") * 2 >= F.col("n_files"), "library").otherwise("app")
    return c.withColumn("shape", shape)


# Settings that should not stay as they are.
CONFIG_RULES = (("bind-all", "medium", r"\b0\.0\.0\.0\b"), ("plain-http", "low", r"http://[a-z0-9.-]+\.[a-z]{2,}"), ("latest-tag", "low", r":latest\b"), ("privileged", "high", r"(?i)privileged\s*:\s*true"), ("root-user", "medium", r"(?i)^\s*user\s+root\b"))


#: Numbers and addresses that the samples of files keep in code.
SAMPLE_RULES = (*CONFIG_RULES, ("fixed-number", "low", r"(?i)\b(const|final int)\s+\w+\s*=\s*[0-9]{3,}"), ("fixed-name", "low", r"^[A-Z_]+\s*=\s*[0-9]+$"))


@query(f"WITH {sample_lines_sql(_ENDS)} " + " UNION ALL ".join(f"SELECT file, line, '{r}' AS rule, '{s}' AS severity FROM l WHERE regexp_matches(content, '{p}')" for r, s, p in SAMPLE_RULES))
def config_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan_lines(sample_lines(spark, d), SAMPLE_RULES, comments=True)


@query(GRAPH + f""", {_COMMITS}, k AS (SELECT DISTINCT commit_id, file FROM commits), t AS (SELECT file, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT a.file, b.file AS other, count(*)::BIGINT AS support FROM k a JOIN k b ON a.commit_id = b.commit_id AND a.file <> b.file GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT p.file, other FROM p JOIN t ON t.file = p.file WHERE round(support / n, 6) >= 0.3),
c AS (SELECT 'file:' || s.repo_id || ':' || s.path AS file, count(DISTINCT e.src_id)::BIGINT AS n FROM e JOIN s ON s.id = e.dst_id WHERE e.kind IN {REFS} GROUP BY 1),
m AS (SELECT file, count(*)::BIGINT AS n FROM r GROUP BY 1)
SELECT f.id AS file, coalesce(c.n, 0) AS n_callers, coalesce(m.n, 0) AS n_cochanged FROM f LEFT JOIN c ON c.file = f.id LEFT JOIN m ON m.file = f.id""")
def change_kit(spark: SparkSession, d: str) -> DataFrame:
    """Per file: distinct callers of its symbols, and files that change with it. Every indexing day of a repository counts as a
    commit, however many files it has: such a day grows with the table and is no sweeping commit."""
    return _kit(spark, d, None)


def _kit(spark: SparkSession, d: str, max_files: int | None) -> DataFrame:
    g = graph.load_graph(spark, d)
    rules_ = evolve.cochange(commits_of(spark, d), max_files, min_support=2).groupBy("file").agg(F.count("*").alias("n_cochanged"))
    s = g.symbols.select(F.col("id").alias("dst_id"), F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("file"))
    c = g.edges.where(F.col("kind").isin(graph.REFERENCES)).select("src_id", "dst_id").join(s, "dst_id").select("file", "src_id").distinct().groupBy("file").agg(F.count("*").alias("n_callers"))
    f = g.files.select(F.col("id").alias("file"))
    return f.join(c, "file", "left").join(rules_, "file", "left").na.fill(0, ["n_callers", "n_cochanged"])


@query(GRAPH + f", t AS (SELECT DISTINCT e.dst_id AS id, e.src_id AS test_id FROM e JOIN s ON s.id = e.src_id WHERE e.kind = 'calls' AND ({matches('s.path', paths.TEST)} OR regexp_matches(s.name, '^(check|verify)'))) SELECT id, test_id FROM t")
def nearby_tests(spark: SparkSession, d: str) -> DataFrame:
    """Direct test callers of every symbol: those in test paths, and functions that check something by name."""
    g = graph.load_graph(spark, d)
    t = g.symbols.where(paths.path_flag("test", F.col("path")) | F.col("name").rlike("^(check|verify)")).select(F.col("id").alias("caller"))
    return graph.callers(g, ["calls"]).join(t, "caller", "left_semi").select(F.col("callee").alias("id"), F.col("caller").alias("test_id"))


@query(GRAPH + _bfs("a AS (SELECT DISTINCT e.dst_id AS src, e.src_id AS dst FROM e JOIN s ON s.id = e.src_id WHERE e.kind IN ('calls','imports'))", "SELECT 'sdk' AS seed, id AS node FROM sdk_symbols", 4) + "SELECT node, depth FROM r WHERE depth > 0")
def dependency_distances(spark: SparkSession, d: str) -> DataFrame:
    """Least number of call or import steps from a symbol to the shared SDK, within four."""
    g = graph.load_graph(spark, d)
    (sdk,) = driver_tables(spark, d, "sdk_symbols")
    r = traverse.reach(traverse.arcs(g, "upstream", ["calls", "imports"]), sdk.select(F.lit("sdk").alias("seed"), F.col("id").alias("node")), 4)
    return r.where("depth > 0").select("node", "depth")
