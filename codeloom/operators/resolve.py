"""Unresolved references bound to symbols by a cascade of strategies.

A strategy looks at the candidates of a name in one scope (the file, the directory, all that are no fixtures, ...). The
candidates of every (name, scope) are first reduced to their number and their least and greatest id, which is all that
is needed to tell whether exactly one is left besides the caller itself; references then meet these aggregates by
equi-join. References are never multiplied by candidates, however common a name is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.graph import Graph

# Strategies in order with the confidence they stamp and what that says about the edge.
STRATEGIES = ["unique", "recv_type", "type_kind", "same_file", "import", "same_dir", "same_subtree", "non_fixture", "non_vendor", "impl_over_decl"]
CONFIDENCE = {"unique": 0.9, "recv_type": 0.9, "type_kind": 0.8, "same_file": 0.9, "import": 0.8, "same_dir": 0.8, "same_subtree": 0.7, "non_fixture": 0.7, "non_vendor": 0.7, "impl_over_decl": 0.5}
BANDS = ((0.9, "exact"), (0.8, "scoped"), (0.7, "name_only"), (0.0, "inferred"))


def provenance(confidence):
    out = F.lit(BANDS[-1][1])
    for least, label in reversed(BANDS[:-1]):
        out = F.when(confidence >= least, label).otherwise(out)
    return F.when(confidence.isNull(), F.lit(None)).otherwise(out)


def placeholders(g: Graph) -> DataFrame:
    """(edge_id, edge_kind, src_id, ref_repo, ref_path, name, recv) of edges to unresolved names.

    ``A.b`` splits at the last dot where A starts with a capital.
    """
    e = g.edges.where("dst_id LIKE 'symref:%'")
    full = paths.ref_name(F.col("dst_id"))
    typed = full.rlike(r"^[A-Z][^.]*(\..*)?\.[^.]+$")
    return e.select(
        F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), "src_id", F.regexp_extract("dst_id", r"^symref:([^:]*):", 1).alias("ref_repo"),
        F.regexp_extract("dst_id", r"^symref:[^:]*:(.*):[^:]*$", 1).alias("ref_path"), F.when(typed, F.substring_index(full, ".", -1)).otherwise(full).alias("name"),
        F.when(typed, F.regexp_replace(full, r"\.[^.]+$", "")).alias("recv"),
    )


def _sole(n, low, high):
    """The only candidate besides the caller, else null."""
    src = F.col("src_id")
    return F.when((n == 1) & (low != src), low).when((n == 2) & (low == src), high).when((n == 2) & (high == src), low)


def resolve(g: Graph) -> DataFrame:
    """(edge_id, src_id, dst_id, strategy, confidence) of the references that bind to exactly one symbol.

    The first strategy that leaves exactly one candidate wins; the caller is never a candidate. Names borne by one
    symbol only are settled as ``unique``; the further strategies see names with several.
    """
    r = placeholders(g)
    owner = F.when(F.col("parent_id").startswith("sym:"), F.substring_index("parent_id", ":", -1)).otherwise(F.col("parent_id"))
    s = g.symbols.select(F.col("repo_id").alias("ref_repo"), "name", F.col("id").alias("cand"), "path", "kind", owner.alias("owner"))
    s = s.join(r.select("ref_repo", "name").distinct(), ["ref_repo", "name"], "left_semi")  # only names that are asked for
    lower = F.lower("path")
    name = ["ref_repo", "name"]

    def reduced(d: DataFrame, i: int, *scope: str) -> DataFrame:
        return d.groupBy(*name, *scope).agg(F.count("*").alias(f"n{i}"), F.min("cand").alias(f"low{i}"), F.max("cand").alias(f"high{i}"))

    when = lambda c: F.when(F.coalesce(c, F.lit(False)), F.col("cand"))
    of_name = {
        "unique": F.col("cand"), "type_kind": when(F.col("kind").isin("class", "interface", "struct")), "non_fixture": when(~lower.rlike(paths.FIXTURE)),
        "non_vendor": when(~lower.rlike(paths.VENDOR)), "impl_over_decl": when(lower.rlike(r"\.(c|cc|cpp|cxx)$")),
    }
    at = STRATEGIES.index
    by_name = s.groupBy(*name).agg(*[x for k, c in of_name.items() for x in (F.count(c).alias(f"n{at(k)}"), F.min(c).alias(f"low{at(k)}"), F.max(c).alias(f"high{at(k)}"))])
    r = r.join(by_name, name)
    r = r.withColumns({"dir": paths.dirname(F.col("ref_path")), "root": F.nullif(paths.subtree_root(F.col("ref_path")), F.lit("")), "recv_owner": F.substring_index("recv", ".", -1)})
    scopes = (
        ("recv_type", s.withColumn("recv_owner", F.col("owner")), "recv_owner"), ("same_file", s.withColumn("ref_path", F.col("path")), "ref_path"),
        ("same_dir", s.withColumn("dir", paths.dirname(F.col("path"))), "dir"), ("same_subtree", s.withColumn("root", F.nullif(paths.subtree_root(F.col("path")), F.lit(""))), "root"),
    )
    for k, d, scope in scopes:
        r = r.join(reduced(d.where(F.col(scope).isNotNull()), at(k), scope), [*name, scope], "left")
    # an import names a candidate's file without extension, or its directory
    modules = g.edges.where("kind = 'imports' AND dst_id LIKE 'mod:%'").select(F.regexp_extract("src_id", r"^file:([^:]*):", 1).alias("ref_repo"), paths.id_path(F.col("src_id")).alias("ref_path"), F.regexp_extract("dst_id", r"^mod:[^:]*:(.*)$", 1).alias("module")).distinct()
    i = at("import")
    keyed = s.withColumn("module", F.explode(F.array_distinct(F.array(paths.strip_extension(F.col("path")), paths.dirname(F.col("path"))))))
    per_file = reduced(keyed, i, "module").join(modules, ["ref_repo", "module"]).groupBy(*name, "ref_path")
    # the same candidate by file and by directory is one: then least and greatest are equal
    per_file = per_file.agg(F.when(F.min(f"low{i}") == F.max(f"high{i}"), F.lit(1)).otherwise(F.sum(f"n{i}")).alias(f"n{i}"), F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}"))
    r = r.join(per_file, [*name, "ref_path"], "left")

    sole = {k: _sole(F.col(f"n{at(k)}"), F.col(f"low{at(k)}"), F.col(f"high{at(k)}")) for k in STRATEGIES}
    sole["type_kind"] = F.when(F.col("edge_kind").isin("inherits", "implements"), sole["type_kind"])
    # a name with one symbol is settled at once, for better or worse
    first = F.when(F.col("n0") == 1, F.when(sole["unique"].isNotNull(), 0)).otherwise(F.coalesce(*[F.when(sole[k].isNotNull(), F.lit(at(k))) for k in STRATEGIES]))
    r = r.withColumn("pick", first).where("pick IS NOT NULL")
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    chosen = F.coalesce(*[F.when(F.col("pick") == at(k), sole[k]) for k in STRATEGIES])
    label = F.element_at(F.array(*[F.lit(k) for k in STRATEGIES]), F.col("pick") + 1)
    return r.select("edge_id", "src_id", chosen.alias("dst_id"), label.alias("strategy")).withColumn("confidence", F.element_at(table, F.col("strategy")))


def resolution_stats(g: Graph) -> DataFrame:
    """One row: references, resolved, ambiguous (several candidates, none chosen) and without any candidate."""
    r = placeholders(g).select("edge_id", "ref_repo", "name")
    n = g.symbols.select(F.col("repo_id").alias("ref_repo"), "name").distinct().withColumn("any", F.lit(True))
    done = resolve(g).select("edge_id").withColumn("done", F.lit(True))
    d = r.join(n, ["ref_repo", "name"], "left").join(done, "edge_id", "left")
    return d.agg(F.count("*").alias("total"), F.count_if("done").alias("resolved"), F.count_if(F.col("done").isNull() & F.col("any").isNotNull()).alias("ambiguous"), F.count_if(F.col("done").isNull() & F.col("any").isNull()).alias("unresolved"))


def apply_resolutions(g: Graph, resolved: DataFrame) -> DataFrame:
    """The edge table with placeholders replaced; equal new edges keep their greatest confidence."""
    old = g.edges.join(resolved.select(F.col("edge_id").alias("id")), "id", "left_anti").select("repo_id", "id", "kind", "src_id", "dst_id", "confidence")
    e = g.edges.select("repo_id", F.col("id").alias("edge_id"), "kind").join(resolved, "edge_id")
    new = e.select("repo_id", F.concat_ws(":", F.lit("e"), "repo_id", "src_id", "kind", "dst_id").alias("id"), "kind", "src_id", "dst_id", "confidence")
    return old.unionByName(new).groupBy("id").agg(F.first("repo_id").alias("repo_id"), F.first("kind").alias("kind"), F.first("src_id").alias("src_id"), F.first("dst_id").alias("dst_id"), F.max("confidence").alias("confidence"))


def revert_into(g: Graph, changed: DataFrame) -> DataFrame:
    """changed(repo_id, path) -> the edge table with resolved references into those files turned back into placeholders.

    All resolvable kinds are turned back; a method is named ``Type.name``, the rest by name.
    """
    s = g.symbols.join(changed, ["repo_id", "path"], "left_semi")
    owner = F.when(F.col("parent_id").startswith("sym:"), F.substring_index("parent_id", ":", -1)).otherwise(F.col("parent_id"))
    named = F.when((F.col("kind") == "method") & owner.isNotNull() & (owner != ""), F.concat_ws(".", owner, "name")).otherwise(F.col("name"))
    t = s.select(F.col("id").alias("dst_id"), named.alias("ref"))
    into = g.edges.where(F.col("kind").isin("calls", "reads", "inherits", "implements")).join(t, "dst_id")
    ref = F.concat_ws(":", F.lit("symref"), F.regexp_extract("src_id", r"^[a-z]+:([^:]*):", 1), paths.id_path(F.col("src_id")), "ref")
    back = into.select("repo_id", "kind", "src_id", ref.alias("dst_id"), F.lit(0.5).alias("confidence"), F.col("id").alias("was"))
    new = back.select("repo_id", F.concat_ws(":", F.lit("e"), "repo_id", "src_id", "kind", "dst_id").alias("id"), "kind", "src_id", "dst_id", "confidence").distinct()
    kept = g.edges.join(into.select("id"), "id", "left_anti").select(*new.columns)
    return kept.unionByName(new)
