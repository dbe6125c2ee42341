"""Queries that extract definitions and imports from source texts (here the samples of files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.plans.base import GRAPH, query
from codeloom.runtime import driver_tables
from codeloom.sources import extract
from codeloom.sources.grammars import ALIASES, DEFINITIONS

LANGUAGES = ["typescript", "javascript", "go", "java", "kotlin", "csharp", "rust", "ruby", "php", "dart", "cpp", "swift", "scala"]


def sample_files(spark: SparkSession, d: str) -> DataFrame:
    (samples,) = driver_tables(spark, d, "file_samples")
    f = graph.load_graph(spark, d).files.where(F.col("language").isin(LANGUAGES))
    s = samples.where("file_id IS NOT NULL AND head IS NOT NULL").select(F.col("file_id").alias("id"), F.col("head").alias("content")).distinct()
    return f.join(s, "id").select("repo_id", "path", "language", "content")


_LINES = "t AS (SELECT f.repo_id, f.path, f.language, string_split(replace(replace(head, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS x FROM f JOIN (SELECT DISTINCT file_id, head FROM file_samples WHERE head IS NOT NULL) s ON s.file_id = f.id), l AS (SELECT repo_id, path, language, unnest(x) AS content, generate_subscripts(x, 1)::INT AS line FROM t)"
_NO = ", ".join(f"'{w}'" for w in sorted(extract.WORDS))


def _names(language: str) -> str:
    cases = []
    for _, p in DEFINITIONS[ALIASES.get(language, language)]:
        e = f"regexp_extract(content, '{p.replace(chr(39), chr(39) * 2)}', 1)"
        cases.append(f"WHEN {e} <> '' AND {e} NOT IN ({_NO}) THEN {e}")
    return f"WHEN language = '{language}' THEN CASE {' '.join(cases)} END"


@query(GRAPH + f", {_LINES}, n AS MATERIALIZED (SELECT repo_id, path, line, CASE {' '.join(_names(x) for x in LANGUAGES)} END AS name FROM l) SELECT repo_id, path, line AS line_start, name FROM n WHERE name IS NOT NULL")
def extracted_definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract(sample_files(spark, d)).where("row = 'symbol'")
    return rows.select("repo_id", "path", "line_start", "name")


_IMPORT = extract.IMPORTS.pattern.replace("'", "''")


@query(GRAPH + f", {_LINES}, m AS (SELECT DISTINCT repo_id, path, coalesce({', '.join(f'nullif(regexp_extract(content, {chr(39)}{_IMPORT}{chr(39)}, {k}), {chr(39) * 2})' for k in range(1, extract.IMPORTS.groups + 1))}) AS module FROM l WHERE language IN ({', '.join(repr(x) for x in LANGUAGES)})) SELECT * FROM m WHERE module IS NOT NULL")
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract(sample_files(spark, d)).where("row = 'edge' AND kind = 'imports'")
    return rows.select("repo_id", "path", F.regexp_extract("dst_id", "^mod:[^:]*:(.*)$", 1).alias("module")).distinct()


def _kinds(language: str) -> str:
    cases = []
    for k, p in DEFINITIONS[ALIASES.get(language, language)]:
        e = f"regexp_extract(content, '{p.replace(chr(39), chr(39) * 2)}', 1)"
        cases.append(f"WHEN {e} <> '' AND {e} NOT IN ({_NO}) THEN '{k}|' || {e}")
    return f"WHEN language = '{language}' THEN CASE {' '.join(cases)} END"


@query(GRAPH + f", {_LINES}, n AS MATERIALIZED (SELECT repo_id, path, line, CASE {' '.join(_kinds(x) for x in LANGUAGES)} END AS found FROM l), k AS (SELECT repo_id, path, line AS line_start, split_part(found, '|', 1) AS kind, regexp_extract(found, '[|](.*)$', 1) AS name FROM n WHERE found IS NOT NULL) SELECT * FROM k WHERE kind IN ('class', 'interface', 'enum') AND regexp_matches(name, '(Worker|Handler|Ledger)')")
def defined_types(spark: SparkSession, d: str) -> DataFrame:
    """Structural search: types in source texts by kind and name."""
    rows = extract.extract(sample_files(spark, d)).where("row = 'symbol'")
    return extract.structural(rows, ["class", "interface", "enum"], "(Worker|Handler|Ledger)").select("repo_id", "path", "line_start", "kind", "name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.k.none') AS missing FROM events")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.functions import text as T

    (e,) = driver_tables(spark, d, "events")
    return e.select("event_id", T.json_path(F.col("props"), "k").alias("v"), T.json_path(F.col("props"), "k.none").alias("missing"))


@query("""WITH s AS (SELECT package AS name, 2 AS priority, 'https://docs.example/' || package AS url FROM vocabularies WHERE symbol_count > 50 AND package IS NOT NULL UNION ALL SELECT package, 1, 'file:/docs/' || package FROM vocabularies WHERE starts_with(package, 'p')),
b AS (SELECT name, arg_min(url, (priority, url)) AS url FROM s GROUP BY 1), w AS (SELECT DISTINCT package AS name FROM vocabularies WHERE package IS NOT NULL)
SELECT name, coalesce(url, 'https://any.example/' || name) AS url, CASE WHEN url IS NULL THEN 'derived' ELSE 'listed' END AS origin FROM w LEFT JOIN b USING (name)""")
def doc_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where the documentation of each package is: own overrides first, then listed sites, else one made from the name."""
    from codeloom.operators import docs

    (v,) = driver_tables(spark, d, "vocabularies")
    p = v.where("package IS NOT NULL")
    listed = p.where("symbol_count > 50").select(F.col("package").alias("name"), F.lit(2).alias("priority"), F.concat(F.lit("https://docs.example/"), "package").alias("url"))
    own = p.where("package LIKE 'p%'").select(F.col("package").alias("name"), F.lit(1).alias("priority"), F.concat(F.lit("file:/docs/"), "package").alias("url"))
    return docs.resolved_sources(p.select(F.col("package").alias("name")), own.unionByName(listed), "https://any.example/{}")


@query("WITH c AS (SELECT DISTINCT run_id AS key, tool_name, min(step_index) AS place FROM ch_tool_calls WHERE tool_name <> '' GROUP BY ALL) SELECT tool_name AS key, min(place) AS place FROM c GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def first_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools in the order of the step in which they come first."""
    from codeloom.operators import ranking

    (calls,) = driver_tables(spark, d, "ch_tool_calls")
    return ranking.first_distinct(calls.select(F.col("tool_name").alias("key"), F.col("step_index").alias("place")), "key", "place", 25)
