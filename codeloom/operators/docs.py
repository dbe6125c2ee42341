"""Link indexes of documentation sites and compact tabular texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.search import weighted_tokens

LINK = r"^\s*[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)\s*:?\s*(.*)$"


def link_index(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (id, pos, section, title, url, note): links of markdown lists under their headings."""
    d = docs.where("text IS NOT NULL").select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section", F.coalesce(F.last(F.when(F.col("line").rlike(r"^##+\s"), F.trim(F.regexp_replace("line", r"^#+\s*", ""))), True).over(w), F.lit("")))
    return d.where(F.col("line").rlike(LINK)).select("id", "pos", "section", *[F.regexp_extract("line", LINK, i).alias(c) for i, c in ((1, "title"), (2, "url"), (3, "note"))])


def select_links(links: DataFrame, topic: str, k: int = 5) -> DataFrame:
    """The k links of each index that fit the topic best; titles count three times as much as sections and notes."""
    terms = F.array(*[F.lit(t) for t in weighted_tokens(topic)]) if weighted_tokens(topic) else F.array().cast("array<string>")
    score = 3 * T.term_score(F.col("title"), terms) + T.term_score(F.concat_ws(" ", "section", "note"), terms)
    d = links.withColumn("score", F.round(score, 6)).where("score > 0")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= k)


def compact(value, indent: int = 0) -> str:
    """A JSON-like value as compact indented text; a list of flat dicts with the same keys becomes a table."""
    pad = "  " * indent

    def scalar(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        s = str(v)
        return s if re.fullmatch(r"[^\s,:\[\]{}\"][^,:\n\"]*[^\s,:\"]|[^\s,:\[\]{}\"]", s) and s not in ("null", "true", "false") and not re.fullmatch(r"-?\d+(\.\d+)?", s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    flat = lambda v: not isinstance(v, (dict, list))
    if flat(value):
        return pad + scalar(value)
    lines = []
    if isinstance(value, dict):
        for k, v in value.items():
            if flat(v):
                lines.append(f"{pad}{k}: {scalar(v)}")
            elif isinstance(v, list):
                lines.append(pad + k + _list(v, indent, scalar, flat))
            else:
                lines += [f"{pad}{k}:", compact(v, indent + 1)]
        return "\n".join(lines)
    return pad + _list(value, indent, scalar, flat)


def _list(v, indent, scalar, flat):
    pad = "  " * (indent + 1)
    if all(flat(x) for x in v):
        return f"[{len(v)}]: " + ",".join(scalar(x) for x in v)
    if all(isinstance(x, dict) and x and list(x) == list(v[0]) and all(flat(y) for y in x.values()) for x in v):
        return "\n".join([f"[{len(v)}]{{{','.join(v[0])}}}:", *[pad + ",".join(scalar(y) for y in x.values()) for x in v]])
    return "\n".join([f"[{len(v)}]:", *[pad + "- " + compact(x, indent + 2).lstrip() for x in v]])


def resolved_sources(wanted: DataFrame, sources: DataFrame, derived: str) -> DataFrame:
    """wanted(name), sources(name, priority, url) -> (name, url, origin): of each name the source of the least priority
    number, then the least url; names without any get ``derived`` with the name in place of ``{}``."""
    best = sources.where("url IS NOT NULL").groupBy("name").agg(F.min(F.struct("priority", "url")).alias("b"))
    d = wanted.select("name").distinct().join(best, "name", "left")
    made = F.replace(F.lit(derived), F.lit("{}"), F.col("name"))
    return d.select("name", F.coalesce("b.url", made).alias("url"), F.when(F.col("b").isNull(), "derived").otherwise("listed").alias("origin"))
