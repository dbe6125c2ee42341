"""Interface contracts found in texts, and links between repositories that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind and pattern of the key, on whole texts.
PATTERNS = (
    ("http", r"(?m)^\s*[\"']?(/[A-Za-z0-9_{}/-]+)[\"']?\s*:\s*$"),
    ("graphql", r"(?m)^\s*type\s+([A-Z][A-Za-z0-9_]*)\s*\{"),
    ("rpc", r"(?m)^\s*rpc\s+([A-Za-z0-9_]+)\s*\("),
    ("message", r"(?m)^\s*message\s+([A-Za-z0-9_]+)\s*\{"),
    ("service", r"(?m)^\s*service\s+([A-Za-z0-9_]+)\s*\{"),
    ("event", r"(?m)[\"']?(?:type|event|channel)[\"']?\s*:\s*[\"']([a-z0-9_]+(?:\.[a-z0-9_]+)+)[\"']"),
)


def discover(texts: DataFrame) -> DataFrame:
    """texts(repo_id, path, text) -> distinct (repo_id, path, kind, key)."""
    tagged = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), tagged(kind)) for kind, p in PATTERNS]))
    return texts.where("text IS NOT NULL").select("repo_id", "path", F.explode(found).alias("x")).select("repo_id", "path", "x.kind", "x.key").distinct()


def links(hits: DataFrame) -> DataFrame:
    """(kind, key, n_repos, n_paths) of keys in two repositories or files at least."""
    places = hits.select("kind", "key", "repo_id", "path").distinct()
    repos = places.groupBy("kind", "key", "repo_id").agg(F.count("*").alias("n"))
    d = repos.groupBy("kind", "key").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n_paths"))
    return d.where("n_repos >= 2 OR n_paths >= 2")


def import_contracts(g) -> DataFrame:
    """Modules that files import, as contracts between repositories."""
    e = g.edges.where("kind = 'imports' AND dst_id LIKE 'mod:%'")
    return e.select("repo_id", F.col("src_id").alias("path"), F.lit("module").alias("kind"), F.regexp_extract("dst_id", r"^mod:[^:]*:(.*)$", 1).alias("key"))
