"""Source trees, git history, logs, findings and judgments as DataFrames."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

MAX_BYTES = 1_500_000

# Folders that are never walked.
SKIP = [".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", ".idea", ".cache"]


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, size_bytes, hash, content) of the known source files below a folder, without ignored ones.

    ``ignore`` holds patterns of ignore files in order, as ``load_ignores`` gives them; without them they are read here.
    """
    rules = load_ignores(root) if ignore is None else ignore
    base = "file:" + os.path.abspath(root).rstrip("/") + "/"
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + re.escape(re.sub(r"^file:/+", "file:/", base)), "")
    d = d.where(F.col("length") <= max_bytes).withColumn("path", rel)
    d = d.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIP]))).where(F.lower("path").rlike(paths.CODE) | F.lower("path").rlike(r"\.(md|ya?ml|json|toml|html|css|proto|graphql|tf)$"))
    if rules:

        @F.pandas_udf("boolean")
        def ignored(p):
            match = compiled(rules)
            return p.map(match)

        d = d.where(~ignored("path"))
    return d.select("path", paths.language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def load_ignores(root: str) -> list[str]:
    """Patterns of .git/info/exclude and of all .gitignore files, those of a folder prefixed by it."""
    out = []
    exclude = os.path.join(root, ".git/info/exclude")
    if os.path.exists(exclude):
        out += [x for x in open(exclude, errors="replace").read().splitlines() if x.strip() and not x.startswith("#")]
    for folder, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if x not in SKIP]
        if ".gitignore" in names:
            at = os.path.relpath(folder, root)
            for x in open(os.path.join(folder, ".gitignore"), errors="replace").read().splitlines():
                if x.strip() and not x.startswith("#"):
                    no, x = (("!", x[1:]) if x.startswith("!") else ("", x))
                    x = x.rstrip()
                    if at != ".":
                        x = f"/{at}/{x.lstrip('/')}" if "/" in x.rstrip("/") else f"/{at}/**/{x}"
                    out.append(no + x)
    return out


def compiled(patterns: list[str]):
    """A predicate over relative paths; the last pattern that matches decides, as git has it."""
    rules = []
    for p in patterns:
        keep = p.startswith("!")
        p = p[1:] if keep else p
        folder = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        rx = ""
        i = 0
        while i < len(p):
            if p.startswith("**/", i):
                rx, i = rx + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                rx, i = rx + ".*", i + 2
            elif p[i] == "*":
                rx, i = rx + "[^/]*", i + 1
            elif p[i] == "?":
                rx, i = rx + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                end = p.index("]", i + 1)
                rx, i = rx + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                rx, i = rx + re.escape(p[i]), i + 1
        rules.append((not keep, re.compile(("" if anchored else "(?:.*/)?") + rx + ("/.*" if folder else "(?:/.*)?") + r"\Z")))

    def match(path: str) -> bool:
        hit = False
        for ignore, rx in rules:
            if rx.match(path):
                hit = ignore
        return hit

    return match


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120, check=True).stdout


def commits(spark: SparkSession, root: str, most: int = 1500) -> DataFrame:
    """(commit_id, at, file) of the newest commits without merges, one row a touched file; commits without files are left out."""
    rows, commit, at = [], None, None
    for line in _git(root, "log", "--no-merges", "--name-only", f"-n{most}", "--format=%x01%H %ct").splitlines():
        if line.startswith("\x01"):
            commit, at = line[1:].split()
        elif line.strip():
            rows.append((commit, int(at), line))
    return spark.createDataFrame(rows, "commit_id string, at long, file string")


def changes(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(status, path) against a ref, the working tree included, untracked files as ``?``; an unknown ref falls back to HEAD."""
    try:
        _git(root, "rev-parse", "--verify", "--quiet", base + "^{commit}")
    except subprocess.CalledProcessError:
        base = "HEAD"
    rows = [(x.split("\t")[0][:1], x.split("\t")[-1]) for x in _git(root, "diff", "--name-status", base).splitlines() if "\t" in x]
    rows += [("?", x) for x in _git(root, "ls-files", "--others", "--exclude-standard").splitlines()]
    return spark.createDataFrame(rows, "status string, path string")


def unified_diff(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(diff_id, text), one row."""
    return spark.createDataFrame([(base, _git(root, "diff", "--no-color", base))], "diff_id string, text string")


def usage_log(spark: SparkSession, *files: str) -> DataFrame:
    """Tool-call events of JSON-lines logs with a fixed schema; broken lines are left out."""
    schema = "ts timestamp, session string, client string, tool string, req_bytes int, resp_bytes int, resp_tokens int, latency_ms long, is_error boolean, args string, snippet string, _bad string"
    d = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(list(files))
    return d.where("tool IS NOT NULL").drop("_bad")


def session_totals(spark: SparkSession, *files: str) -> DataFrame:
    """Token totals per session of transcripts: sums of increments, and the last value of cumulative counters."""
    d = spark.read.schema("session string, ts timestamp, tokens long, cumulative boolean").json(list(files))
    return d.where("session IS NOT NULL").groupBy("session").agg(F.coalesce(F.max_by("tokens", F.when(F.col("cumulative"), F.col("ts"))), F.sum("tokens")).alias("tokens"))


def sarif(spark: SparkSession, *files: str) -> DataFrame:
    """(rule, severity, file, line, message) of SARIF results."""
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>"
    d = spark.read.schema(f"runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{place}>>>>>").option("multiLine", True).json(list(files))
    r = d.select(F.explode("runs").alias("r")).select(F.explode("r.results").alias("x"))
    at = F.get("x.locations", 0)["physicalLocation"]
    return r.select(F.col("x.ruleId").alias("rule"), F.coalesce("x.level", F.lit("warning")).alias("severity"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"))


def qrels(spark: SparkSession, file: str) -> DataFrame:
    """(query_id, query, relevant) of judgments, one row per relevant name part."""
    d = spark.read.schema("queries array<struct<id:string,query:string,relevant:array<string>>>").option("multiLine", True).json(file)
    return d.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.query", F.explode("q.relevant").alias("relevant"))


def golden_suite(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.schema("cases array<struct<query:string,must_contain_path:array<string>,top_k:int>>").option("multiLine", True).json(file).select(F.explode("cases").alias("c")).select("c.*")


def log_tail(spark: SparkSession, file: str, n: int = 200) -> DataFrame:
    """(line, text) of the last n lines of a log."""
    d = spark.read.text(file, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    first = F.greatest(F.size(lines) - n, F.lit(0))
    return d.select(F.posexplode(F.slice(lines, first + 1, F.lit(n))).alias("i", "text"), first.alias("first")).select((F.col("first") + F.col("i") + 1).alias("line"), "text")


def jdbc_query(spark: SparkSession, url: str, sql: str, limit: int = 200, **options: str) -> DataFrame:
    """Rows of a guarded read-only statement on an external database, pushed down whole."""
    from codeloom.operators.rules import check_read_only

    return spark.read.format("jdbc").option("url", url).option("query", check_read_only(sql)).option("queryTimeout", "30").options(**options).load().limit(limit)


def catalog_schema(spark: SparkSession, tables: list[str] | None = None) -> DataFrame:
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() if not tables or t.name in tables for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")


def grep(spark: SparkSession, folder: str, name: str, limit: int = 40) -> DataFrame:
    """(file, line, text, is_definition) of lines with the identifier as a word; definitions come first."""
    d = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "text"))
    word = rf"\b{re.escape(name)}\b"
    hit = d.where(F.col("text").rlike(word)).select("file", (F.col("i") + 1).alias("line"), F.trim("text").alias("text"), F.col("text").rlike(r"\b(def|func|function|class|fn|interface|struct|type)\s+(\([^)]*\)\s*)?" + re.escape(name) + r"\b").alias("is_definition"))
    return hit.orderBy(F.desc("is_definition"), "file", "line").limit(limit)


# Line patterns of lock files and manifests, with name and version as groups.
PINS = {
    "go.sum": r"(?m)^(\S+) v([\w.+-]+?)(?:/go\.mod)? h1:",
    "requirements.txt": r"(?m)^([A-Za-z0-9_.\[\]-]+)==([\w.+-]+)",
    "cargo.lock": r"(?ms)^name = \"([^\"]+)\"\s*\nversion = \"([^\"]+)\"",
    "poetry.lock": r"(?ms)^name = \"([^\"]+)\"\s*\nversion = \"([^\"]+)\"",
    "package-lock.json": r"\"(?:node_modules/)?([^\"]+)\"\s*:\s*\{\s*\"version\"\s*:\s*\"([^\"]+)\"",
    "yarn.lock": r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:\s*\n\s+version \"([^\"]+)\"",
    "gemfile.lock": r"(?m)^    ([\w.-]+) \(([\w.]+)\)",
    "go.mod": r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+) v([\w.+-]+)",
}


def lock_pins(texts: DataFrame) -> DataFrame:
    """texts(path, content) -> distinct (path, name, version) of the dependencies that lock files and manifests pin."""
    name = F.lower(F.substring_index("path", "/", -1))
    found = F.array().cast("array<struct<name:string,version:string>>")
    for f, p in PINS.items():
        pair = F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(p), 1).alias("a"), F.regexp_extract_all("content", F.lit(p), 2).alias("b")), lambda x: F.struct(x["a"].alias("name"), x["b"].alias("version")))
        found = F.when(name == f, pair).otherwise(found)
    return texts.where("content IS NOT NULL").select("path", F.explode(found).alias("x")).select("path", "x.name", "x.version").distinct()
