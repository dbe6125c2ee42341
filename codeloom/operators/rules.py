"""Rule scans over lines, unified diffs, findings and the read-only SQL guard."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Id, severity, pattern (on the line without its comment). Own rules; both engines read the patterns alike.
SECURITY_RULES = (
    ("hardcoded-secret", "high", r"(?i)(api_?key|secret|password|token)\s*[:=]\s*[\"'][^\"']{6,}[\"']"),
    ("dynamic-eval", "high", r"\b(eval|exec)\s*\("),
    ("shell-injection", "high", r"(?i)(os\.system|subprocess\.(call|run|popen)|exec\.command)\s*\(.*\+"),
    ("sql-concat", "high", r"(?i)(select|insert|update|delete)\s.*[\"']\s*\+"),
    ("weak-hash", "medium", r"(?i)\b(md5|sha1)\s*\("),
    ("tls-off", "high", r"(?i)(insecureskipverify\s*[:=]\s*true|verify\s*=\s*false)"),
    ("debug-on", "low", r"(?i)\bdebug\s*[:=]\s*true\b"),
    ("embedded-blob", "medium", r"[\"'][A-Za-z0-9+/]{120,}"),
    ("open-cors", "medium", r"(?i)access-control-allow-origin.*\*"),
)
NOTE_RULES = (("left-over", "low", r"(?i)\b(todo|fixme|hack)\b"), ("reverted", "low", r"(?i)\breverted\b"), ("lost-value", "medium", r"(?i)\bwas lost after\b"), ("no-owner", "low", r"(?i)\bno owner\b"), ("destructive-ddl", "high", r"(?i)\b(drop table|truncate table|alter table .* drop)\b"))
SEVERITY = {"critical": 8, "high": 5, "medium": 2, "low": 1}


def strip_comment(line):
    return F.regexp_replace(line, r"(^|\s)(//|#).*$", "")


def scan_lines(lines: DataFrame, rules, comments: bool = False) -> DataFrame:
    """lines(file, line, content) -> (file, line, rule, severity), one row per rule that a line breaks.

    All rules are tested in one expression per line; only hits leave the scan. Comments are cut off unless wanted.
    """
    text = F.col("content") if comments else strip_comment(F.col("content"))
    tests = F.array(*[F.when(text.rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in rules])
    d = lines.where("content IS NOT NULL").select("file", "line", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("x"))
    return d.select("file", "line", "x.rule", "x.severity")


def lines_of(texts: DataFrame, key: str, text: str, ends: str = r"\r\n|\n|\r") -> DataFrame:
    """Numbered lines of texts, or other pieces that end where ``ends`` matches (statements, say)."""
    d = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("file"), F.posexplode(F.split(text, ends)).alias("n", "content"))
    return d.select("file", (F.col("n") + 1).alias("line"), "content")


def severity_weight(severity):
    out = F.lit(0)
    for k, v in SEVERITY.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def rank_findings(findings: DataFrame, k: int | None = None) -> DataFrame:
    """Findings with a rank per file by severity, rule and line."""
    d = findings.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc(severity_weight(F.col("severity"))), "rule", "line")))
    return d if k is None else d.where(F.col("rank") <= k)


def risk_scores(findings: DataFrame) -> DataFrame:
    """Per file: summed severity weights and the risk they make."""
    d = findings.groupBy("file").agg(F.sum(severity_weight(F.col("severity"))).cast("bigint").alias("score"))
    return d.withColumn("risk", F.when(F.col("score") >= 12, "critical").when(F.col("score") >= 7, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def collapse(findings: DataFrame) -> DataFrame:
    """One finding per file, line and rule family (text before the first dash), the severest first."""
    w = Window.partitionBy("file", "line", F.substring_index("rule", "-", 1)).orderBy(F.desc(severity_weight(F.col("severity"))), "rule")
    return findings.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def merge_findings(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union, unique on (lower-case rule, file, line); those of ``base`` win."""
    both = base.withColumn("o", F.lit(0)).unionByName(extra.withColumn("o", F.lit(1)))
    w = Window.partitionBy(F.lower("rule"), "file", "line").orderBy("o", F.desc(severity_weight(F.col("severity"))))
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "o")


def parse_diff(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, text), unified -> (diff_id, file, line, hunk, content) of the added lines.

    The state (file, hunk, line number) comes from running windows over each diff's lines.
    """
    d = diffs.where("text IS NOT NULL").select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "s"))
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("file", F.last(F.when(F.col("s").startswith("+++ "), F.regexp_replace(F.regexp_extract("s", r"^\+\+\+ (\S+)", 1), "^b/", "")), True).over(w))
    d = d.withColumn("at", F.when(F.col("s").startswith("@@"), F.regexp_extract("s", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")))
    d = d.withColumn("hunk", F.count("at").over(w)).withColumn("start", F.last("at", True).over(w))
    inside = (F.col("hunk") > 0) & ~F.col("s").rlike(r"^(\+\+\+|---|@@|diff |index )")
    step = F.when(inside & ~F.col("s").startswith("-"), 1).otherwise(0)
    h = Window.partitionBy("diff_id", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("line", F.col("start") + F.sum(step).over(h) - 1)
    return d.where(inside & F.col("s").startswith("+")).select("diff_id", "file", "line", "hunk", F.expr("substring(s, 2)").alias("content"))


def patch_critic(added: DataFrame, pattern: str, unless: list[str]) -> DataFrame:
    """Added lines with the pattern in hunks that hold none of the ``unless`` texts."""
    calm = F.lit(False)
    for u in unless:
        calm = calm | F.contains(F.lower("content"), F.lit(u.lower()))
    w = Window.partitionBy("diff_id", "file", "hunk")
    d = added.withColumn("calm", F.max(calm).over(w))
    return d.where(F.contains(F.lower("content"), F.lit(pattern.lower())) & ~F.col("calm")).select("diff_id", "file", "line", "content")


LOOP = r"^\s*(for|while|foreach)\b"
CALL = r"(?i)(query|fetch|load|store|request|open)\w*\s*\("


def loop_calls(lines: DataFrame, window: int = 12, loop: str = LOOP, call: str = CALL) -> DataFrame:
    """lines(file, line, content) -> calls that look like IO within ``window`` lines after the start of a loop."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumn("loop_line", F.last(F.when(F.col("content").rlike(loop), F.col("line")), True).over(w))
    return d.where(F.col("content").rlike(call) & (F.col("line") - F.col("loop_line") <= window)).select("file", "line", "loop_line")


ALLOWED = re.compile(r"^(select|with|show|describe|desc|explain|values)\b", re.I)
FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|replace|grant|revoke|attach|detach|copy|load|call|lock|vacuum|pragma|set|into\s+(outfile|dumpfile)|for\s+update)\b", re.I)


class NotReadOnly(ValueError):
    pass


def check_read_only(sql: str, spark=None) -> str:
    """The statement, if it is a single read-only one; else NotReadOnly.

    Texts and comments are blanked first, so that words in them neither help nor harm. With a session, the parsed plan
    must hold no command either.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "''", sql)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.S).strip()
    if bare.endswith(";"):
        bare = bare[:-1].rstrip()
    if not bare:
        raise NotReadOnly("empty statement")
    if ";" in bare:
        raise NotReadOnly("several statements")
    if not ALLOWED.match(bare):
        raise NotReadOnly("not a reading statement")
    if m := FORBIDDEN.search(bare):
        raise NotReadOnly(f"{m.group(0)} is not allowed")
    if spark is not None:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
        if plan.getClass().getName().endswith("Command") and not ALLOWED.match(bare):
            raise NotReadOnly("a command")
    return sql.strip().rstrip(";")


def guarded_query(spark, sql: str, limit: int = 200) -> tuple[DataFrame, bool]:
    """Rows of a read-only statement up to the limit, and whether there were more."""
    d = spark.sql(check_read_only(sql, spark))
    rows = d.limit(limit + 1)
    return rows.limit(limit), rows.count() > limit


def rows_as_json(d: DataFrame) -> DataFrame:
    """Every row as JSON with all values as texts and nulls kept."""
    return d.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in d.columns]), {"ignoreNullFields": "false"}).alias("json"))
