"""Queries over the problem tables whose operators belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import balance, hierarchy, orphans
from codeloom.runtime import driver_tables


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    (symbols,) = driver_tables(spark, d, "symbols")
    return hierarchy.symbol_roots(symbols)


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every current symbol with its path (names joined by ``/``), depth, root and number of descendants."""
    (symbols,) = driver_tables(spark, d, "symbols")
    return hierarchy.symbol_tree(symbols)


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol below every current symbol, with the steps between them; rings and what is below them have none."""
    (symbols,) = driver_tables(spark, d, "symbols")
    return hierarchy.symbol_descendants(symbols)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    (edges,) = driver_tables(spark, d, "edges")
    return balance.heavy_keys(edges, ["repo_id", "dst_id"], "id")


def p5_dst_profile(spark: SparkSession, d: str) -> DataFrame:
    edges, symbols, sdk = driver_tables(spark, d, "edges", "symbols", "sdk_symbols")
    nodes = symbols.select("id", "name").unionByName(sdk.select("id", "name"))
    return balance.profile(edges, nodes)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.code_orphans(*driver_tables(spark, d, "edges", "ch_tool_calls", "symbols", "sdk_symbols", "files", "ch_runs"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_dst_profile, p6_found, p6_report)}

_CUR = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {at} DESC) AS rn FROM {t}) WHERE rn = 1"

_LINKS = f"""cur AS ({_CUR.format(t="symbols", at="indexed_at")}),
  owners AS (SELECT repo_id, path, name, min(id) AS id FROM cur WHERE kind IN ('class','interface','enum','namespace','module','type_alias') GROUP BY ALL),
  links AS (
    SELECT c.id, CASE WHEN c.parent_id LIKE 'sym:%' THEN p.id ELSE o.id END AS up
    FROM cur c LEFT JOIN cur p ON c.parent_id = p.id AND c.parent_id LIKE 'sym:%'
      LEFT JOIN owners o ON o.repo_id = c.repo_id AND o.path = c.path AND o.name = c.parent_id AND c.parent_id NOT LIKE 'sym:%'
    WHERE c.parent_id IS NOT NULL),
  ends AS (SELECT id, up FROM links WHERE up IS NOT NULL)"""

_P6 = f"""
WITH cs AS ({_CUR.format(t="(SELECT id, indexed_at, removed_at FROM symbols UNION ALL SELECT id, indexed_at, removed_at FROM sdk_symbols)", at="indexed_at")}),
fs AS (SELECT id, min(indexed_at) AS first FROM (SELECT id, indexed_at FROM symbols UNION ALL SELECT id, indexed_at FROM sdk_symbols) GROUP BY id),
ff AS (SELECT id, min(indexed_at) AS first FROM files GROUP BY id),
fr AS (SELECT id, min(created_at) AS first, arg_max(status, created_at) AS status FROM ch_runs GROUP BY id),
ce AS ({_CUR.format(t="edges", at="indexed_at")}), ct AS ({_CUR.format(t="ch_tool_calls", at="logged_at")}),
refs AS (
  SELECT 'edges' AS source_table, 'src_id' AS ref_field, id AS row_id, src_id AS target, indexed_at AS ref_at FROM ce
  UNION ALL SELECT 'edges', 'dst_id', id, dst_id, indexed_at FROM ce
  UNION ALL SELECT 'ch_tool_calls', 'run_id', id, run_id, called_at FROM ct WHERE run_id <> ''),
judged AS (
  SELECT r.*, CASE
    WHEN source_table = 'edges' AND target LIKE 'sym:%' THEN CASE WHEN cs.id IS NULL THEN 'missing' WHEN cs.removed_at IS NOT NULL THEN 'deleted' WHEN fs.first > ref_at THEN 'late' END
    WHEN source_table = 'edges' AND target LIKE 'file:%' THEN CASE WHEN ff.id IS NULL THEN 'missing' WHEN ff.first > ref_at THEN 'late' END
    WHEN source_table = 'ch_tool_calls' THEN CASE WHEN fr.id IS NULL THEN 'missing' WHEN fr.status = 'deleted' THEN 'deleted' WHEN fr.first > ref_at THEN 'late' END END AS reason
  FROM refs r LEFT JOIN cs ON r.target = cs.id LEFT JOIN fs ON r.target = fs.id LEFT JOIN ff ON r.target = ff.id LEFT JOIN fr ON r.target = fr.id)
"""

ORACLES = {
    "p3_found": f"""
WITH RECURSIVE {_LINKS},
  down AS (
    SELECT DISTINCT up AS id, up AS root, 0::BIGINT AS depth FROM ends WHERE up NOT IN (SELECT id FROM ends)
    UNION ALL
    SELECT e.id, d.root, d.depth + 1 FROM ends e JOIN down d ON e.up = d.id)
SELECT l.id AS symbol_id, CASE WHEN l.up IS NULL THEN l.id WHEN d.id IS NULL THEN 'cycle' ELSE d.root END AS root_id,
  CASE WHEN l.up IS NULL THEN 0 WHEN d.id IS NULL THEN -1 ELSE d.depth END::BIGINT AS depth
FROM links l LEFT JOIN down d ON l.id = d.id""",
    "p3_hierarchy": f"""
WITH RECURSIVE {_LINKS},
  down AS (
    SELECT id, id AS root, 0::BIGINT AS depth, name AS path, [id] AS ids FROM cur WHERE id NOT IN (SELECT id FROM ends)
    UNION ALL
    SELECT e.id, d.root, d.depth + 1, d.path || '/' || c.name, list_append(d.ids, e.id) FROM ends e JOIN down d ON e.up = d.id JOIN cur c ON c.id = e.id),
  under AS (SELECT a AS id, count(*) - 1 AS n FROM (SELECT unnest(ids) AS a FROM down) GROUP BY a)
SELECT c.id AS symbol_id, CASE WHEN d.id IS NULL THEN 'cycle' ELSE d.root END AS root_id, CASE WHEN d.id IS NULL THEN -1 ELSE d.depth END::BIGINT AS depth,
  d.path AS path, u.n::BIGINT AS n_descendants
FROM cur c LEFT JOIN down d ON c.id = d.id LEFT JOIN under u ON u.id = c.id""",
    "p3_descendants": f"""
WITH RECURSIVE {_LINKS},
  down AS (
    SELECT id, [id] AS ids FROM cur WHERE id NOT IN (SELECT id FROM ends)
    UNION ALL
    SELECT e.id, list_append(d.ids, e.id) FROM ends e JOIN down d ON e.up = d.id)
SELECT ids[g] AS ancestor, id AS descendant, (len(ids) - g)::BIGINT AS steps FROM (SELECT id, ids, unnest(range(1, len(ids))) AS g FROM down)""",
    "p5_found": """
WITH e AS (SELECT DISTINCT id, repo_id, dst_id FROM edges),
k AS (SELECT 'repo_id' AS key_field, repo_id AS key_item, count(DISTINCT id) AS n FROM e GROUP BY repo_id
  UNION ALL SELECT 'dst_id', dst_id, count(DISTINCT id) FROM e GROUP BY dst_id)
SELECT key_field, key_item FROM k WHERE key_item IS NOT NULL AND n >= 0.01 * (SELECT count(DISTINCT id) FROM e)""",
    "p5_dst_profile": """
SELECT e.dst_id AS key_item, count(DISTINCT e.id)::BIGINT AS edges, count(DISTINCT e.src_id)::BIGINT AS sources, max(n.name) AS target_name
FROM edges e LEFT JOIN (SELECT id, min(name) AS name FROM (SELECT id, name FROM symbols UNION ALL SELECT id, name FROM sdk_symbols) GROUP BY id) n ON n.id = e.dst_id
WHERE e.id IS NOT NULL AND e.dst_id IS NOT NULL GROUP BY e.dst_id""",
    "p6_found": _P6 + "SELECT source_table, ref_field, row_id, reason, strftime(ref_at, '%Y-%m') AS ref_month FROM judged WHERE reason IS NOT NULL",
    "p6_report": _P6 + "SELECT source_table, ref_field, reason, strftime(ref_at, '%Y-%m') AS ref_month, count(*)::BIGINT AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
