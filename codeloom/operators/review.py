"""Checks over changed code, disambiguation of names, promoted methods and import aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.graph import REFERENCES, Graph
from codeloom.runtime import work_area


def test_candidates(path):
    """Paths at which a test of a source file is looked for: beside it by suffix or prefix, and in a tests folder beside it."""
    stem, ext = paths.strip_extension(path), F.concat(F.lit("."), F.substring_index(path, ".", -1))
    folder = F.when(path.contains("/"), F.concat(paths.dirname(path), F.lit("/"))).otherwise(F.lit(""))
    name = F.substring_index(stem, "/", -1)
    return F.array(F.concat(stem, F.lit("_test"), ext), F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext), F.concat(folder, F.lit("test_"), name, ext), F.concat(folder, F.lit("tests/test_"), name, ext), F.concat(folder, F.lit("__tests__/"), name, F.lit(".test"), ext))


def files_with_tests(files: DataFrame) -> DataFrame:
    """(repo_id, path) of the files that have a test file at one of the places where tests are looked for."""
    wanted = files.select("repo_id", "path", F.explode(test_candidates(F.col("path"))).alias("test"))
    there = files.select("repo_id", F.col("path").alias("test"))
    return wanted.join(there, ["repo_id", "test"], "left_semi").select("repo_id", "path").distinct()


def test_gap(g: Graph, changed: DataFrame) -> DataFrame:
    """Functions and methods of changed files without a test file: (id, name, path, risk)."""
    s = g.symbols.where(paths.behavioural(F.col("kind")) & ~paths.path_flag("test", F.col("path"))).join(changed, ["repo_id", "path"], "left_semi")
    return s.join(files_with_tests(g.files), ["repo_id", "path"], "left_anti").select("id", "name", "path", paths.test_risk(F.col("path")).alias("risk"))


def contract_guard(g: Graph, changed: DataFrame) -> DataFrame:
    """Changed symbols that others may rely on: exported or in a public folder, outside internal and private ones."""
    public = paths.is_exported(F.col("name"), F.coalesce("language", F.lit(""))) | F.lower("path").rlike(r"(^|/)(pkg|cmd|api)/")
    hidden = F.lower("path").rlike(r"(^|/)(internal|private)/")
    return g.symbols.join(changed, ["repo_id", "path"], "left_semi").where(public & ~hidden).select("id", "name", "path")


#: Layers by folder of a path, and calls that a layer must not make (fixed values; other rules are given as parameters).
LAYERS = {"model": r"(^|/)(models?|domain|entities|schema)/", "view": r"(^|/)(views?|components|templates|pages)/", "api": r"(^|/)(api|routes|controllers|handlers)/"}
FORBIDDEN = (("model", "view"), ("model", "api"), ("view", "model"))


def layer_of(path, layers=None):
    out = F.lit("other")
    for name, p in reversed(list((layers or LAYERS).items())):
        out = F.when(F.lower(path).rlike(p), name).otherwise(out)
    return out


def architecture_lint(g: Graph, layers=None, forbidden=FORBIDDEN) -> DataFrame:
    """Calls from a layer into one that it must not use: (src_id, dst_id, src_layer, dst_layer)."""
    s = g.symbols.select("id", layer_of(F.col("path"), layers).alias("layer"))
    e = g.edges.where("kind = 'calls'").select("src_id", "dst_id")
    e = e.join(s.select(F.col("id").alias("src_id"), F.col("layer").alias("src_layer")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("layer").alias("dst_layer")), "dst_id")
    bad = F.lit(False)
    for a, b in forbidden:
        bad = bad | ((F.col("src_layer") == a) & (F.col("dst_layer") == b))
    return e.where(bad)


def disambiguate(g: Graph, names: DataFrame, margin: float = 2.0) -> DataFrame:
    """names(name) -> (name, id, how): the symbol meant: the only one, the only one outside fixtures, or the one with
    ``margin`` times the callers of the next; names without such a winner have no row."""
    s = g.symbols.join(names.select("name").distinct(), "name", "left_semi").select("id", "name", paths.path_flag("fixture", F.col("path")).alias("fixture"))
    callers = g.edges.where(F.col("kind").isin(REFERENCES)).select("dst_id", "src_id").distinct().groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("fan_in"))
    s = s.join(callers, "id", "left").na.fill(0, ["fan_in"])
    n = s.groupBy("name").agg(F.count("*").alias("n"), F.count_if(~F.col("fixture")).alias("n_own"), F.min(F.when(~F.col("fixture"), F.col("id"))).alias("own"))
    # two rows a name at most: the rank filter is applied before the shuffle too
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("fan_in"), "id"))).where("r <= 2")
    best = best.groupBy("name").agg(F.max(F.when(F.col("r") == 1, F.col("id"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("fan_in"))).alias("fan_in"), F.max(F.when(F.col("r") == 2, F.col("fan_in"))).alias("next"))
    d = n.join(best, "name")
    how = F.when(F.col("n") == 1, "only").when(F.col("n_own") == 1, "non_fixture").when((F.col("fan_in") > 0) & (F.col("fan_in") >= F.coalesce("next", F.lit(0)) * margin), "fan_in")
    return d.select("name", F.when(how == "non_fixture", F.col("own")).otherwise(F.col("top")).alias("id"), how.alias("how")).where("how IS NOT NULL")


def promoted_methods(methods: DataFrame, embeds: DataFrame, depth: int = 4) -> DataFrame:
    """methods(type, method, id), embeds(type, embedded) -> (type, method, id, depth): methods that a type has through the
    types it embeds, from the shallowest level that has exactly one; several at that level are ambiguous and give no row."""
    area = work_area(methods.sparkSession, "promoted")
    e = area.put(embeds.select("type", "embedded").distinct(), "embeds")
    front = area.put(e.select("type", F.col("embedded").alias("at"), F.lit(1).alias("depth")), "level1")
    levels = [area.path("level1")]
    for k in range(2, depth + 1):
        n = front.join(e.select(F.col("type").alias("at"), F.col("embedded").alias("to")), "at").select("type", F.col("to").alias("at")).distinct().where("type <> at")
        front = area.put(n.join(methods.sparkSession.read.parquet(*levels).select("type", "at"), ["type", "at"], "left_anti").withColumn("depth", F.lit(k)), f"level{k}")
        levels.append(area.path(f"level{k}"))
        if front.isEmpty():
            break
    r = methods.sparkSession.read.parquet(*levels).join(methods.select(F.col("type").alias("at"), "method", "id"), "at")
    r = r.groupBy("type", "method", "depth").agg(F.count("*").alias("n"), F.min("id").alias("id")).groupBy("type", "method").agg(F.min(F.struct("depth", "n", "id")).alias("b"))
    r = r.where("b.n = 1").select("type", "method", "b.id", "b.depth")
    return r.join(methods.select("type", "method"), ["type", "method"], "left_anti").select("type", "method", "id", "depth")


def embeds_of(symbols: DataFrame) -> DataFrame:
    """(type, embedded) from ``embeds=A,B`` in signatures."""
    listed = F.regexp_extract(F.coalesce("signature", F.lit("")), r"embeds=([^ ;]+)", 1)
    return symbols.where(listed != "").select(F.col("name").alias("type"), F.explode(F.split(listed, ",")).alias("embedded")).where("embedded <> ''")


def expand_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports(repo_id, src_id, module), aliases(repo_id, alias, target) -> imports with the longest leading alias replaced.

    Every leading path of a module is a key, so that the prefix match is an equi-join.
    """
    parts = F.split("module", "/")
    i = imports.withColumn("alias", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    hit = i.join(aliases, ["repo_id", "alias"]).groupBy("repo_id", "src_id", "module").agg(F.max(F.struct(F.length("alias").alias("n"), "target")).alias("b"))
    return hit.select("repo_id", "src_id", "module", F.concat(F.col("b.target"), F.expr("substring(module, b.n + 1)")).alias("resolved"))


def enrich(symbols: DataFrame, stored: DataFrame, generate, schema: str = "id string, hash string, purpose string") -> tuple[DataFrame, DataFrame]:
    """(cached, generated): stored(id, hash, purpose) rows that still fit their symbols, and new ones made by
    ``generate(pandas batch) -> pandas batch`` for symbols whose content hash has no row."""
    text = F.concat_ws("\x00", F.coalesce("name", F.lit("")), F.coalesce("signature", F.lit("")), F.coalesce("kind", F.lit("")))
    now = symbols.select("id", "name", "signature", "kind", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))
    cached = stored.join(now.select("id", "hash"), ["id", "hash"], "left_semi")
    todo = now.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")
    return cached, todo.mapInPandas(lambda batches: (generate(b) for b in batches), schema)


def classify(texts: DataFrame, keywords: dict[str, list[str]], default: str = "explain") -> DataFrame:
    """texts(id, text) -> (id, label, score): the label with most keywords in the text, of equals the first listed."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = F.array(*[F.struct(sum((F.contains(low, F.lit(k)).cast("int") for k in ks), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, ks) in enumerate(keywords.items())])
    best = F.array_max(scores)
    return texts.select("id", F.when(best["score"] > 0, best["label"]).otherwise(default).alias("label"), best["score"].alias("score"))


def select_pattern(texts: DataFrame, triggers: dict[str, list[str]]) -> DataFrame:
    """texts(id, text) -> (id, pattern, score): the pattern whose triggers in the text are longest in all; none gives no row."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = F.array(*[F.struct(sum((F.when(F.contains(low, F.lit(t)), len(t)).otherwise(0) for t in ts), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("pattern")) for i, (name, ts) in enumerate(triggers.items())])
    best = F.array_max(scores)
    return texts.select("id", best["pattern"].alias("pattern"), best["score"].alias("score")).where("score > 0")


SOURCE = r"(request|req|params|query|body|argv|input)\b"
SINKS = (("sql", r"(?i)\b(execute|query|raw)\s*\("), ("shell", r"(?i)\b(system|popen|exec|spawn)\s*\("), ("html", r"(?i)(innerhtml\s*=|render_template_string\s*\()"), ("path", r"(?i)\b(open|readfile|sendfile)\s*\("))
ASSIGN = r"^\s*(?:const |let |var )?([A-Za-z_]\w*)\s*(?::=|=)\s*(.+)$"


def dataflow(lines: DataFrame, source: str = SOURCE, sinks=SINKS) -> DataFrame:
    """lines(file, line, content) -> (file, line, sink, name): sinks that use a name assigned from request data before.

    Within each file, names become tainted at their assignment; a sink line after it that has the name as a word is a
    finding. Names and sink lines of a file meet by equi-join, filtered on order and word.
    """
    t = lines.where("content IS NOT NULL")
    tainted = t.where(F.regexp_extract("content", ASSIGN, 2).rlike(source)).select("file", F.col("line").alias("at"), F.regexp_extract("content", ASSIGN, 1).alias("name")).groupBy("file", "name").agg(F.min("at").alias("at"))
    tests = F.array(*[F.when(F.col("content").rlike(p), F.lit(k)) for k, p in sinks])
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)"), 1))
    used = t.select("file", "line", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("sink"), words.alias("words")).select("file", "line", "sink", F.explode("words").alias("name"))
    return used.join(tainted, ["file", "name"]).where(F.col("line") > F.col("at")).select("file", "line", "sink", "name")


def finish_check(findings: DataFrame, gaps: DataFrame, public: DataFrame, max_gaps: int = 0) -> DataFrame:
    """One row that rolls up gates: severe findings, functions without tests, changed public symbols, and the verdict."""
    severe = findings.agg(F.count_if(F.col("severity").isin("critical", "high"))).scalar()
    d = findings.sparkSession.range(1).select(severe.alias("n_severe"), gaps.agg(F.count("*")).scalar().alias("n_gaps"), public.agg(F.count("*")).scalar().alias("n_public"))
    return d.withColumn("verdict", F.when(F.col("n_severe") > 0, "blocked").when(F.col("n_gaps") > max_gaps, "needs_tests").otherwise("ready"))
