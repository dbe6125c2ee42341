"""Signals and forms of ranked symbol search: path hints, qualified names, fused lists with reasons, texts for embeddings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import search
from codeloom.operators.graph import Graph, in_degrees

HINT_BOOST = 1.25
# Names of helpers that everything calls.
HUB_NAMES = ["log", "logger", "error", "err", "cn", "clsx", "cx", "debug", "info", "warn", "fatal", "panic", "assert", "print", "println", "sprintf", "printf", "twmerge", "tw_merge", "classname", "classnames"]


def path_hints(query: str) -> list[str]:
    """Words of a query that read like paths, in order, each once."""
    found = (w.strip("\"'`,;:()[]{}") for w in query.lower().split())
    return list(dict.fromkeys(w for w in found if w and ("/" in w or ".go" in w)))


def hint_boosts(symbols: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, id, boost): a fixed boost for each path hint of a query that the symbol's path contains."""
    asked = []
    for q, text in sorted(queries.items()):
        hints = path_hints(text)
        if hints:
            n = sum((F.contains(F.lower(F.coalesce("path", F.lit(""))), F.lit(h)).cast("int") for h in hints), F.lit(0))
            asked.append(F.struct(F.lit(q).alias("query_id"), (n * HINT_BOOST).alias("boost")))
    if not asked:
        return symbols.sparkSession.createDataFrame([], "query_id string, id string, boost double")
    return symbols.select("id", F.explode(F.array(*asked)).alias("x")).select("x.query_id", "id", "x.boost").where("boost > 0")


def split_qualified(query: str) -> tuple[str, str] | None:
    """The first ``Type.method`` of a query: two identifiers with one dot between them; else None."""
    for w in re.split(r"[\x00-\x20,;()\[\]\"']+", query):
        w = w.strip("`*")
        if re.fullmatch(r"[^\W\d]\w*\.[^\W\d]\w*", w):
            a, b = w.split(".")
            return a, b
    return None


def qualified_names(symbols: DataFrame) -> DataFrame:
    """(qualified, id) of the methods: owner's name, a dot and the method's name."""
    owner = F.when(F.col("parent_id").startswith("sym:"), F.substring_index("parent_id", ":", -1)).otherwise(F.col("parent_id"))
    m = symbols.where("kind = 'method' AND parent_id <> ''")
    return m.select(F.concat_ws(".", owner, "name").alias("qualified"), "id")


def qualified_search(symbols: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, id) of the methods that qualified names in queries mean."""
    asked = [(q, ".".join(x)) for q, t in sorted(queries.items()) if (x := split_qualified(t))]
    d = symbols.sparkSession.createDataFrame(asked, "query_id string, qualified string")
    return qualified_names(symbols).join(F.broadcast(d), "qualified").select("query_id", "id")  # one row a stated query


def is_hub_utility(name: Column) -> Column:
    """Helpers by name, and their short wrappers (at most six characters longer)."""
    n = F.lower(F.coalesce(name, F.lit("")))
    wrap = F.lit(False)
    for u in HUB_NAMES:
        wrap = wrap | ((F.startswith(n, F.lit(u)) | F.endswith(n, F.lit(u))) & (F.length(n) <= len(u) + 6))
    return n.isin(HUB_NAMES) | wrap


def merged_expansions(*terms: DataFrame) -> DataFrame:
    """terms(query_id, term, weight) of several sources -> the greatest weight of each term."""
    whole = terms[0]
    for t in terms[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def reasons(lists: Column) -> Column:
    """Distinct reasons without empty ones, in order of name."""
    return F.array_sort(F.array_distinct(F.filter(lists, lambda x: x.isNotNull() & (x != ""))))


def rrf_reasons(a: DataFrame, b: DataFrame, k: int = 60, offset: int = 100) -> DataFrame:
    """Two ranked lists (query_id, id, rank, reason) fused by reciprocal ranks: (query_id, id, score, reasons)."""
    part = lambda d, o: d.select("query_id", "id", "reason", (1.0 / (k + o + F.col("rank"))).alias("s"))
    both = part(a, 0).unionByName(part(b, offset)).groupBy("query_id", "id")
    out = both.agg(F.sum("s").alias("score"), F.collect_set("reason").alias("r"))  # a reason a list
    return out.select("query_id", "id", "score", F.when(F.size(reasons(F.col("r"))) > 0, reasons(F.col("r"))).otherwise(F.array(F.lit("rrf"))).alias("reasons"))


def query(g: Graph, text: str, k: int = 10) -> DataFrame:
    """The best symbols for one text."""
    return search.hybrid(g.symbols, in_degrees(g.edges), {"q": text}, k).select("id", "score", "rank")


def path_context(path: Column) -> Column:
    """Last folder and stem of a path."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"(.)\.[^./]*$", "$1")
    return F.regexp_replace(F.regexp_extract(p, r"([^/]*/)?[^/]*$", 0), "/", " ")


def embedding_text(name: Column, path: Column, signature: Column) -> Column:
    """What a symbol is embedded by: name, its words, and the signature, else the place it stands in.

    A signature that only holds ``key=value`` marks counts as none.
    """
    words, own = T.humanize(name), F.coalesce(name, F.lit(""))
    sig = F.trim(F.coalesce(signature, F.lit("")))
    good = (sig != "") & ~sig.rlike(r"^[a-z_]+=\S*$")
    rest = F.when(good, sig).otherwise(T.humanize(path_context(path)))
    parts = F.array(own, F.when((words != "") & (words != own), words), F.when(rest != "", rest))
    return F.trim(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def with_enrichment(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """docs(id, doc), stored(id, purpose, aliases ARRAY) -> docs with the stored texts of each appended."""
    extra = stored.groupBy("id").agg(F.max(F.concat_ws(" ", "purpose", "aliases")).alias("extra"))
    return docs.join(extra, "id", "left").select("id", F.lower(F.concat_ws(" ", "doc", "extra")).alias("doc"))


def is_synthetic(name: Column, path: Column, language: Column) -> Column:
    """Symbols that no code stands behind: routes made up by an indexer, style rules, markup and data files."""
    n, ext = F.coalesce(name, F.lit("")), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.[^./]*$", 0))
    style = n.startswith("@keyframes") | n.rlike(r"^[.#]|^--")
    return n.rlike("(?i)" + paths.SYNTHETIC_ROUTE) | style | ext.isin(".css", ".scss", ".sass", ".less", ".md", ".mdx", ".html", ".htm", ".json", ".yaml", ".yml", ".toml") | F.lower(F.coalesce(language, F.lit(""))).isin("css", "scss")


# Kinds of symbols.
KINDS = ["function", "method", "class", "interface", "enum", "variable", "type_alias", "namespace", "module"]


def parse_kinds(text: str) -> list[str]:
    """Kinds of a comma list, in order, each once; unknown ones are an error."""
    out = list(dict.fromkeys(k.strip().lower() for k in text.split(",") if k.strip()))
    if bad := [k for k in out if k not in KINDS]:
        raise ValueError(f"unknown kinds: {', '.join(bad)}")
    return out


def embedded(docs: DataFrame, embed, batch: int = 256) -> DataFrame:
    """docs(id, body) -> (id, v): vectors made by ``embed(list of texts) -> list of vectors``, a service or a model that the
    tasks can reach, for ``batch`` texts at a time; null texts have null vectors."""

    def run(batches):
        for b in batches:
            texts = b["body"].tolist()
            have = [i for i, t in enumerate(texts) if isinstance(t, str)]
            out = [None] * len(texts)
            for a in range(0, len(have), batch):
                part = have[a : a + batch]
                for i, v in zip(part, embed([texts[i] for i in part])):
                    out[i] = [float(x) for x in v]
            b = b[["id"]].copy()
            b["v"] = out
            yield b

    return docs.select("id", "body").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, v array<double>")


def first_distinct(d: DataFrame, key: str, place: str, limit: int | None = None) -> DataFrame:
    """Rows with the first place of each key, in that order; empty and null keys are dropped."""
    first = d.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(place).alias(place))
    return first if limit is None else first.orderBy(place, key).limit(limit)
