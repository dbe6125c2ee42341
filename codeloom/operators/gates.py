"""Checks of changes over whole repositories: distance of findings, budgets, destructive statements, readiness, guidance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths

RISKS = ["low", "medium", "high", "critical"]


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def finding_distance(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """findings(repo_id, path, rule, ...), changed(repo_id, path) -> findings with ``distance``: 0 in a changed file, 1 where a
    segment of the path is the name of a changed file of the repository, else 2."""
    exact = changed.select("repo_id", "path").distinct().withColumn("exact", F.lit(True))
    names = changed.select("repo_id", base_name(F.col("path")).alias("seg")).distinct()
    near = findings.select("repo_id", "path").distinct().withColumn("seg", F.explode(F.split(F.regexp_replace("path", r"\\", "/"), "/"))).join(names, ["repo_id", "seg"]).select("repo_id", "path").distinct().withColumn("near", F.lit(True))
    d = findings.join(exact, ["repo_id", "path"], "left").join(near, ["repo_id", "path"], "left")
    return d.withColumn("distance", F.when(F.col("exact"), 0).when(F.col("near"), 1).otherwise(2)).drop("exact", "near")


def change_budget(changed: DataFrame, max_files: int) -> DataFrame:
    """changed(repo_id, path) -> (repo_id, n_files, within): whether no more files changed than allowed (0: any number)."""
    n = changed.distinct().groupBy("repo_id").agg(F.count("*").alias("n_files"))
    return n.withColumn("within", F.lit(True) if max_files <= 0 else F.col("n_files") <= max_files)


# Severity and pattern of statements that lose data or break what relies on a table; the first that matches counts.
DESTRUCTIVE = (
    ("drop-table", "critical", r"(?i)\bdrop\s+table\b"),
    ("truncate", "critical", r"(?i)\btruncate\s+(table\s+)?\S"),
    ("alter-drop", "high", r"(?i)\balter\s+table\b[^;]*\bdrop\s+(column|constraint|index)\b"),
    ("builder-drop", "high", r"(?i)drop_?column"),
    ("drop-key", "high", r"(?i)\bdrop\s+(unique|primary|foreign\s+key|constraint|index)\b"),
    ("not-null", "high", r"(?i)\balter\s+table\b[^;]*\bset\s+not\s+null\b"),
    ("delete-all", "high", r"(?i)\bdelete\s+from\s+\S+\s*;?\s*$"),
    ("rename", "medium", r"(?i)\brename\s+(column|table)\b|renamecolumn"),
)
MIGRATION_PATH = r"\.sql$|(^|/)(migrations?|migrate)/"


def migration_guard(added: DataFrame) -> DataFrame:
    """added(file, line, content) -> (file, line, rule, severity) of destructive statements added to SQL files and migrations.

    Lines that are comments are left out; a line is found once, by the first rule that it breaks.
    """
    text = F.trim("content")
    lines = added.where(F.lower("file").rlike(MIGRATION_PATH) & (text != "") & ~text.rlike(r"^(--|//)"))
    found = F.lit(None).cast("struct<rule:string,severity:string>")
    for rule, severity, p in reversed(DESTRUCTIVE):
        found = F.when(text.rlike(p), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))).otherwise(found)
    return lines.select("file", "line", found.alias("x")).where("x IS NOT NULL").select("file", "line", "x.rule", "x.severity")


def readiness(repos: DataFrame, findings: DataFrame, breaking: DataFrame, gaps: DataFrame, blocking: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """repos(repo_id), findings(repo_id, severity), breaking(repo_id), gaps(repo_id) -> a row a repository: (repo_id,
    n_blocking, n_breaking, n_gaps, ship, required)."""
    count = lambda d, c: d.groupBy("repo_id").agg(F.count("*").alias(c))
    d = repos.select("repo_id").distinct().join(count(findings.where(F.col("severity").isin(*blocking)), "n_blocking"), "repo_id", "left")
    d = d.join(count(breaking, "n_breaking"), "repo_id", "left").join(count(gaps, "n_gaps"), "repo_id", "left").na.fill(0, ["n_blocking", "n_breaking", "n_gaps"])
    ship = (F.col("n_blocking") == 0) & (F.col("n_breaking") == 0)
    required = F.concat_ws("; ", F.when(~ship, F.lit("resolve blocking findings")), F.when(F.col("n_gaps") > 0, F.lit("add tests for changed symbols")))
    return d.select("*", ship.alias("ship"), required.alias("required"))


def risk_rank(risk: Column) -> Column:
    out = F.lit(0)
    for k, v in enumerate(RISKS):
        out = F.when(F.lower(risk) == v, k + 1).otherwise(out)
    return out


def worst_risk(rows: DataFrame, by: str) -> DataFrame:
    """The worst tier of each group; unknown tiers count least."""
    return rows.groupBy(by).agg(F.max(F.struct(risk_rank(F.col("risk")).alias("k"), F.col("risk"))).getField("risk").alias("risk"))


# What tells how a repository is reached over HTTP, the first that holds; patterns of paths.
SURFACES = (("framework", r"(^|/)(manage\.py|artisan|gin\.go|config/routes\.rb)$"), ("app", r"(^|/)(routes?|controllers?|handlers?|pages|api)/"), ("manifest", r"(^|/)(package\.json|pyproject\.toml|go\.mod|composer\.json|pom\.xml)$"))


def http_surface(files: DataFrame, surfaces=SURFACES, native: int = 15) -> DataFrame:
    """files(repo_id, path) -> (repo_id, kind, capable): many C sources and no sign of an application is no HTTP server."""
    p = F.lower(F.coalesce("path", F.lit("")))
    n = files.groupBy("repo_id").agg(F.count_if(p.rlike(r"\.(c|cc|cpp)$")).alias("n_native"), *[F.count_if(p.rlike(x)).alias(k) for k, x in surfaces])
    kind = F.lit("unknown")
    for k, _ in reversed(surfaces):
        kind = F.when(F.col(k) > 0, k).otherwise(kind)
    signs = F.lit(False)
    for k, _ in surfaces[:2]:
        signs = signs | (F.col(k) > 0)
    kind = F.when((F.col("n_native") >= native) & ~signs, "non_http").otherwise(kind)
    return n.select("repo_id", kind.alias("kind"), (~kind.isin("unknown", "non_http")).alias("capable"))


def guidance(files: DataFrame, shapes: DataFrame, hints, limit: int = 3) -> DataFrame:
    """files(repo_id, path), shapes(repo_id, shape), hints[(rule, shape, pattern of the path)] -> (repo_id, rule, path, place):
    the first ``limit`` files, by path, that each hint for a repository's shape is anchored in."""
    from pyspark.sql import Window

    p = F.lower(F.coalesce("path", F.lit("")))
    tests = F.array(*[F.when((F.col("shape") == s) & p.rlike(x), F.lit(r)) for r, s, x in hints])
    d = files.select("repo_id", "path").distinct().join(shapes.select("repo_id", "shape"), "repo_id")
    d = d.select("repo_id", "path", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("rule"))
    place = F.row_number().over(Window.partitionBy("repo_id", "rule").orderBy("path"))
    return d.withColumn("place", place).where(F.col("place") <= limit).select("repo_id", "rule", "path", "place")


def task_tier(text: Column, confidence: Column, entities: Column, intent: Column) -> Column:
    """fast, standard or deep: how far a task should be looked into, by how sure and how broad it is."""
    low, short = F.lower(F.coalesce(text, F.lit(""))), F.length(F.coalesce(text, F.lit(""))) < 110
    broad = low.rlike("entire codebase|whole repo|all packages|across the project|major refactor")
    checks = intent.isin("review", "dead_code", "perf", "security")
    sure = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when((sure < 0.72) | (entities > 6) | broad, "deep")
        .when(checks, F.when((sure >= 0.85) & short, "standard").otherwise("deep"))
        .when((sure >= 0.85) & short & (entities <= 2) & intent.isin("explain", "feature", "bugfix", "refactor"), "fast")
        .when(intent == "explain", "fast").when((intent == "feature") & (sure >= 0.88) & (entities <= 3), "fast").otherwise("standard")
    )


def expanded_requests(texts: DataFrame, selected: DataFrame, requirements: DataFrame, fallback: str) -> DataFrame:
    """texts(id), selected(id, pattern), requirements(pattern, requirement) -> (id, pattern, requirements): what a request of
    the pattern asks for, each once and in order; without a pattern the fallback's."""
    wanted = requirements.groupBy("pattern").agg(F.array_sort(F.collect_set("requirement")).alias("requirements"))  # a stated table
    d = texts.select("id").join(selected.select("id", "pattern"), "id", "left").withColumn("pattern", F.coalesce("pattern", F.lit(fallback)))
    return d.join(F.broadcast(wanted), "pattern", "left").select("id", "pattern", F.coalesce("requirements", F.array().cast("array<string>")).alias("requirements"))


# imports ---------------------------------------------------------------------------------------------------------------


def repo_rooted(module: Column) -> Column:
    """Whether an import reads like a path of the repository: a slash, but no scope, namespace, address or domain."""
    return module.contains("/") & ~module.rlike(r"^[@#~/]") & ~module.contains("\\") & ~module.contains("://") & ~F.substring_index(module, "/", 1).contains(".")


def namespaced_candidates(imports: DataFrame, candidates: DataFrame) -> DataFrame:
    """imports(caller, module), candidates(id, name, path) -> (caller, id): symbols that ``A\\B\\Name`` imports mean: the
    last part is the symbol's and its file's name, the path holds the namespace or its parent."""
    i = imports.where(F.contains("module", F.lit("\\"))).select("caller", F.replace(F.trim("module"), F.lit("\\"), F.lit("/")).alias("psr"), F.regexp_extract("module", r"([^\\]*)$", 1).alias("name"))
    c = candidates.select("id", "name", F.regexp_replace("path", r"\\", "/").alias("p")).where(base_name(paths.strip_extension(F.col("p"))) == F.col("name"))
    parent = F.regexp_replace("psr", "/[^/]*$", "")
    d = i.join(c, "name").where(F.contains("p", F.col("psr")) | ((parent != "") & (parent != F.col("psr")) & F.contains("p", parent)))
    return d.select("caller", "id").distinct()


def prefer_hinted(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """candidates(name, id, path), hints(name, hint) -> the candidates whose path holds a hint for their name; names without
    a hint, or without a candidate that has it, keep all."""
    d = candidates.join(hints.groupBy("name").agg(F.collect_set("hint").alias("hints")), "name", "left")  # a stated table
    d = d.withColumn("fits", F.coalesce(F.exists("hints", lambda h: F.contains(F.col("path"), h)), F.lit(False)))
    some = d.where("fits").select("name").distinct().withColumn("some", F.lit(True))
    return d.join(some, "name", "left").where(F.col("some").isNull() | F.col("fits")).select("name", "id", "path")


ROOTS = (("go.mod", r"(?m)^module\s+(\S+)"), ("package.json", r'"name"\s*:\s*"([^"]+)"'), ("pyproject.toml", r'(?m)^name\s*=\s*"([^"]+)"'), ("cargo.toml", r'(?m)^name\s*=\s*"([^"]+)"'), ("composer.json", r'"name"\s*:\s*"([^"]+)"'))


def import_roots(manifests: DataFrame) -> DataFrame:
    """manifests(repo_id, path, text) -> (repo_id, root): the module names that a repository's manifests give it."""
    name = F.lower(base_name(F.col("path")))
    root = F.lit("")
    for file, p in reversed(ROOTS):
        root = F.when(name == file, F.regexp_extract("text", p, 1)).otherwise(root)
    return manifests.where("text IS NOT NULL").select("repo_id", root.alias("root")).where("root <> ''").distinct()


def import_aliases(configs: DataFrame) -> DataFrame:
    """configs(repo_id, text), JSON with ``compilerOptions.paths`` -> (repo_id, alias, target); text that is no JSON gives none."""
    kind = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    d = configs.select("repo_id", F.from_json("text", kind).alias("c")).select("repo_id", F.col("c.compilerOptions.baseUrl").alias("base"), F.explode("c.compilerOptions.paths").alias("alias", "targets"))
    clean = lambda c: F.regexp_replace(c, r"/?\*$", "")
    d = d.select("repo_id", "base", clean(F.col("alias")).alias("alias"), F.explode("targets").alias("t"))
    base = F.when(F.coalesce("base", F.lit(".")).isin(".", "./", ""), F.lit("")).otherwise(F.concat(F.regexp_replace("base", r"^\./|/$", ""), F.lit("/")))
    return d.select("repo_id", "alias", F.concat(base, F.regexp_replace(clean(F.col("t")), r"^\./", "")).alias("target")).distinct()


def lock_version(lines: list[str], name: str) -> str | None:
    """The first version that lines of a lock file give a package."""
    p = re.compile(rf"(?:^|[\"'/\s]){re.escape(name)}[\"']?[@:\s=]+[\"']?v?(\d+(?:\.\d+)+\S*?)[\"',]?(?:\s|$)")
    return next((m[1] for x in lines if (m := p.search(x))), None)
