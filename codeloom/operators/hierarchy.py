"""Roots, depths, paths and descendants of parent-child links of unknown depth, by tree contraction.

Each round rakes all leaves and splices an independent set of nodes out of unary chains (a node with one child, picked
where its pseudo-random priority beats its child's and its parent's). What a round removes is recorded with the node it
hung from and the number of steps to it; the active set shrinks by a constant factor a round, whatever the depth. Rings
shrink to self-loops, the cores that never end. Then the records are replayed backwards: a removed node's root and depth
follow from those of the node it hung from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeloom.runtime import WorkArea, work_area

CYCLE = -1


def contract(area: WorkArea, links: DataFrame, paths: bool = False, sizes: bool = False, max_rounds: int = 400) -> DataFrame:
    """links(node BIGINT, parent BIGINT[, label STRING]), one row a node -> (node, root, depth[, path][, below]).

    Nodes that are only parents are roots and get no row. On a ring or below one: root -1, depth -1, path and below null.
    ``path`` holds the labels (else the nodes) from the child of the root down to the node itself. ``below`` is the number
    of nodes under the node, without any pair of ancestor and descendant being made: a raked leaf hands its count to the
    node it hung from, a spliced node hands its own to the link that replaces it and takes its child's at the replay.

    The replay reads, for the nodes of a round, what later rounds found: as many rows as were still alive, which over all
    rounds add up to a multiple of the nodes.
    """
    first = "label" if "label" in links.columns else "node"
    extra = [F.array(first).alias("path")] if paths else []
    # acc: the node and what was raked into it; mass: nodes spliced out of the link to the parent, with what they had
    extra += [F.lit(1).cast("bigint").alias("acc"), F.lit(0).cast("bigint").alias("mass")] if sizes else []
    active = area.put(links.select("node", "parent", F.lit(1).alias("w"), *extra), "alive0")
    carried = [c for c in ("path", "acc", "mass") if c in active.columns]
    recorded_as = StructType([*active.schema.fields, *([StructField("child", LongType()), StructField("child_mass", LongType())] if sizes else [])])
    step_of = lambda rounds, out: area.read([f"steps{k}/out={out}" for k in rounds], recorded_as)
    recorded: list[int] = []
    alive = not active.isEmpty()
    for k in range(1, max_rounds + 1):
        if not alive:
            break
        rank = lambda c: F.xxhash64(c, F.lit(k))  # noqa: B023, E731
        ring = F.col("node") == F.col("parent")
        live = active.where(~ring)
        children = live.groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("only"), *([F.min("mass").alias("only_mass")] if sizes else []))
        of_child = ["only", "only_mass"] if sizes else ["only"]
        below = children.select(F.col("parent").alias("node"), F.col("n").alias("below"), *of_child)
        beside = children.select("parent", F.col("n").alias("beside"))
        v = live.join(beside, "parent").join(below, "node", "left")
        alone = (F.col("below") == 1) & (rank(F.col("node")) > rank(F.col("only")))
        v = v.withColumn("cut", F.coalesce(alone & ((F.col("beside") > 1) | (rank(F.col("node")) > rank(F.col("parent")))), F.lit(False)))
        v = v.select("node", "parent", "w", *carried, *(of_child if sizes else []), F.col("below").isNull().alias("leaf"), F.col("cut").cast("int").alias("cut"))
        v = area.put(v, f"seen{k}", ["cut"])
        cut = v.where("cut = 1")
        over = cut.select(F.col("node").alias("parent"), F.col("parent").alias("up"), F.col("w").alias("up_w"), *([F.col("path").alias("up_path")] if paths else []), *([(F.col("acc") + F.col("mass")).alias("up_mass")] if sizes else []))
        kept = v.where("cut = 0").join(over, "parent", "left")
        longer = [F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("up_path", "path")).alias("path")] if paths else []
        longer += [F.col("acc"), (F.col("mass") + F.coalesce("up_mass", F.lit(0))).alias("mass")] if sizes else []
        kept = kept.select("node", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"), *longer, F.when(F.col("leaf"), 1).otherwise(0).alias("out"))
        no_child = [F.lit(None).cast("bigint").alias(c) for c in ("child", "child_mass")] if sizes else []
        if sizes:
            given = kept.where("out = 1").groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("acc") + F.col("mass")).alias("given"))
            kept = kept.join(given, "node", "left").withColumn("acc", F.col("acc") + F.coalesce("given", F.lit(0)))
        cores = active.where(ring).select("node", "parent", "w", *carried, *no_child, F.lit(2).alias("out"))
        gone = cut.select("node", "parent", "w", *carried, *([F.col("only").alias("child"), F.col("only_mass").alias("child_mass")] if sizes else []), F.lit(1).alias("out"))
        step = kept.select("node", "parent", "w", *carried, *no_child, "out").unionByName(gone).unionByName(cores)
        area.put(step, f"steps{k}", ["out"])
        area.drop(f"seen{k}", f"alive{k - 1}" if k == 1 else f"steps{k - 1}/out=0")
        recorded.append(k)
        active, alive = step_of([k], 0).select("node", "parent", "w", *carried), "0" in area.parts(f"steps{k}")
    else:
        raise RuntimeError(f"contraction did not end in {max_rounds} rounds")

    spark = links.sparkSession
    kind = active.schema["path"].dataType if paths else None
    done: list[str] = []
    if recorded:
        # rings first: what hung from a core may have been removed after the core was found
        cores = step_of(recorded, 2)
        none = [*([F.lit(None).cast(kind).alias("path")] if paths else []), *([F.lit(None).cast("bigint").alias("below")] if sizes else [])]
        area.put(cores.select("node", F.lit(CYCLE).cast("bigint").alias("root"), F.lit(-1).cast("bigint").alias("depth"), *none), "found0")
        done.append(area.path("found0"))
    for k in range(len(recorded), 0, -1):
        rec = step_of([k], 1)
        later = spark.read.parquet(*done)
        known = later.select(F.col("node").alias("parent"), F.col("root").alias("top"), F.col("depth").alias("above"), *([F.col("path").alias("head")] if paths else []))
        lost = F.coalesce("top", F.lit(0)) == CYCLE
        if sizes:  # a spliced node's child went later, or as a leaf of this round
            counts = later.select(F.col("node").alias("child"), F.col("below").alias("under")).unionByName(rec.where("child IS NULL").select(F.col("node").alias("child"), (F.col("acc") - 1).alias("under")))
            rec = rec.join(counts, "child", "left")
        rec = rec.join(known, "parent", "left")
        whole = [F.when(lost, None).when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path")] if paths else []
        if sizes:
            own = F.col("acc") - 1 + F.when(F.col("child").isNull(), 0).otherwise(F.col("child_mass") + F.col("under") + 1)
            whole.append(F.when(lost, None).otherwise(own).cast("bigint").alias("below"))
        new = rec.select("node", F.when(lost, F.lit(CYCLE)).otherwise(F.coalesce("top", "parent")).cast("bigint").alias("root"), F.when(lost, F.lit(-1)).otherwise(F.coalesce("above", F.lit(0)) + F.col("w")).cast("bigint").alias("depth"), *whole)
        area.put(new, f"found{k}")
        if not sizes:
            area.drop(f"steps{k}")
        done.append(area.path(f"found{k}"))
    if not done:
        empty = [F.array(first).alias("path")] if paths else []
        empty += [F.lit(0).cast("bigint").alias("below")] if sizes else []
        return links.select("node", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth"), *empty).where("false")
    if not sizes:
        return spark.read.parquet(*done)
    # roots have no record of their own: what was raked into each node, of which only roots' counts are wanted
    found = spark.read.parquet(*done)
    raked = step_of(recorded, 1).where("child IS NULL").groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("acc") + F.col("mass")).alias("below"))
    tops = raked.join(links.select("node"), "node", "left_anti")
    cols = ["node", "root", "depth", *(["path"] if paths else []), "below"]
    tops = tops.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), *([F.array().cast(kind).alias("path")] if paths else []), "below")
    return found.select(*cols).unionByName(tops)


def numbered(area: WorkArea, nodes: DataFrame, key: str) -> DataFrame:
    """The nodes, written once, with a dense-enough number each, so that the rounds move 8-byte keys and not texts."""
    return area.put(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def hierarchy(nodes: DataFrame, links: DataFrame, paths: bool = False) -> DataFrame:
    """nodes(key STRING unique, ...), links(key, parent_key) of those with a parent that exists -> one row per node of
    ``nodes``: (key, root_key, depth[, path]).

    A node without a link is its own root (depth 0). Ring members and whatever hangs below a ring: root_key 'cycle',
    depth -1, path null. Null keys are ignored; a link given twice counts once (the least parent wins); a link to a
    parent that is no node counts as none. ``path`` is the array of keys from the root to the node.
    """
    spark = nodes.sparkSession
    area = work_area(spark, "hierarchy")
    book = numbered(area, nodes.where(F.col("key").isNotNull()).select("key"), "key")
    pairs = links.where("key IS NOT NULL AND parent_key IS NOT NULL").groupBy("key").agg(F.min("parent_key").alias("parent_key"))
    ids = book.select("key", F.col("nid").alias("node"))
    e = pairs.join(ids, "key").select("node", "parent_key", F.col("key").alias("label")).join(ids.select(F.col("key").alias("parent_key"), F.col("node").alias("parent")), "parent_key").select("node", "parent", *(["label"] if paths else []))
    found = contract(area, e, paths)
    return named(book.select("nid", "key"), found, paths)


def named(book: DataFrame, found: DataFrame, paths: bool) -> DataFrame:
    """book(nid, key) with what ``contract`` found, in keys."""
    cols = ["node", "root", "depth", *(["path"] if paths else [])]
    r = book.withColumnRenamed("nid", "node").join(found.select(*cols), "node", "left")
    tops = book.select(F.col("nid").alias("root"), F.col("key").alias("top_key"))
    r = r.join(tops, "root", "left")
    root = F.when(F.col("root").isNull(), F.col("key")).when(F.col("root") == CYCLE, F.lit("cycle")).otherwise(F.col("top_key"))
    path = F.when(F.col("root").isNull(), F.array("key")).otherwise(F.concat(F.array("top_key"), "path"))  # null on rings
    return r.select("key", root.alias("root_key"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), *([path.alias("path")] if paths else []))


def descendants(tree: DataFrame) -> DataFrame:
    """Of ``hierarchy(..., paths=True)``: one row per (ancestor, descendant, steps), so a root with a third of all nodes
    stays spread over all tasks."""
    e = tree.where("path IS NOT NULL AND depth > 0").select(F.col("key").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("at", "ancestor"))
    return e.select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("steps"))


OWNER_KINDS = ["class", "interface", "enum", "namespace", "module", "type_alias"]


def symbol_links(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current symbols written with numbers, and their links: (book, links(node, parent), area of the tables).

    A parent_id that starts with ``sym:`` names a symbol by id; any other non-empty one names an owner of the same
    repo_id and path, of an owner kind. Should several owners share the name, the least id is meant.
    """
    from codeloom.operators.current import latest

    area = work_area(symbols.sparkSession, "symbols")
    cur = latest(symbols, ["id"], "indexed_at", ["repo_id", "path", "name", "kind", "parent_id"]).drop("indexed_at")
    book = area.put(cur.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    by_id = book.where("parent_id LIKE 'sym:%'").select(F.col("nid").alias("node"), F.col("parent_id").alias("id"))
    by_id = by_id.join(book.select("id", F.col("nid").alias("parent")), "id").select("node", "parent")
    owners = book.where(F.col("kind").isin(OWNER_KINDS)).groupBy("repo_id", "path", F.col("name").alias("parent_id")).agg(F.min_by("nid", "id").alias("parent"))
    by_name = book.where("parent_id NOT LIKE 'sym:%'").select(F.col("nid").alias("node"), "repo_id", "path", "parent_id")
    by_name = by_name.join(owners, ["repo_id", "path", "parent_id"]).select("node", "parent")
    return book, by_id.unionByName(by_name), area


def symbol_roots(symbols: DataFrame) -> DataFrame:
    """(symbol_id, root_id, depth) of each current symbol whose parent_id is not null."""
    book, links, area = symbol_links(symbols)
    found = contract(area, links)
    held = book.where("parent_id IS NOT NULL").select(F.col("nid").alias("node"), "id").join(found, "node", "left")
    tops = book.select(F.col("nid").alias("root"), F.col("id").alias("top"))
    r = held.join(tops, "root", "left")
    root = F.when(F.col("root").isNull(), F.col("id")).when(F.col("root") == CYCLE, F.lit("cycle")).otherwise(F.col("top"))
    return r.select(F.col("id").alias("symbol_id"), root.alias("root_id"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def symbol_tree(symbols: DataFrame) -> DataFrame:
    """(symbol_id, root_id, depth, path, n_descendants) of every current symbol; path joins names from the root by ``/``.

    On a ring or below one: root_id 'cycle', depth -1, path and n_descendants null.
    """
    book, links, area = symbol_links(symbols)
    label = book.select(F.col("nid").alias("node"), F.coalesce("name", F.lit("")).alias("label"))
    found = contract(area, links.join(label, "node"), paths=True, sizes=True)
    tops = book.select(F.col("nid").alias("root"), F.col("id").alias("top"), F.coalesce("name", F.lit("")).alias("top_name"))
    r = book.select(F.col("nid").alias("node"), "id", "name").join(found, "node", "left").join(tops, "root", "left")
    lost = F.col("root") == CYCLE
    return r.select(
        F.col("id").alias("symbol_id"),
        F.when(F.col("root").isNull(), F.col("id")).when(lost, "cycle").otherwise(F.col("top")).alias("root_id"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.when(lost, None).when(F.col("root").isNull(), F.coalesce("name", F.lit(""))).otherwise(F.array_join(F.concat(F.array("top_name"), "path"), "/")).alias("path"),
        F.when(lost, None).otherwise(F.coalesce("below", F.lit(0))).cast("bigint").alias("n_descendants"),
    )


def symbol_descendants(symbols: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps) of the current symbols, in ids; rings and what is below them give no rows."""
    book, links, area = symbol_links(symbols)
    found = area.put(contract(area, links, paths=True), "paths").where("depth > 0")
    # from the root (which found has no row for) down to the parent
    above = F.concat(F.array("root"), F.slice("path", F.lit(1), F.col("depth").cast("int") - 1))
    pairs = found.select("node", "depth", F.posexplode(above).alias("at", "up")).select("node", "up", (F.col("depth") - F.col("at")).cast("bigint").alias("steps"))
    ids = book.select(F.col("nid").alias("node"), F.col("id").alias("descendant"))
    tops = book.select(F.col("nid").alias("up"), F.col("id").alias("ancestor"))
    return pairs.join(ids, "node").join(tops, "up").select("ancestor", "descendant", "steps")
