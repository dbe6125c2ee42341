"""Markdown chunks and token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 700


def _tokens(s: str) -> int:
    return max(1, len(s.encode()) // 4)


def chunk(text: str, most: int = MAX_TOKENS) -> list[tuple[str, str]]:
    """(heading, body) sections; headings in fences do not count; oversized bodies are packed by paragraph."""
    out, heading, body, fence = [], "", [], False

    def flush():
        whole = "\n".join(body).strip()
        if not whole:
            return
        if _tokens(whole) <= most:
            out.append((heading, whole))
            return
        part: list[str] = []
        for para in whole.split("\n\n"):
            if part and _tokens("\n\n".join([*part, para])) > most:
                out.append((heading, "\n\n".join(part)))
                part = []
            part.append(para)
        if part:
            out.append((heading, "\n\n".join(part)))

    for line in text.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        if not fence and line.startswith("#") and line.lstrip("#").startswith(" "):
            flush()
            heading, body = line.lstrip("#").strip(), []
        else:
            body.append(line)
    flush()
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs(id BIGINT, text) -> (id, pos, heading, body, n_tokens)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for pos, (h, body) in enumerate(chunk(t or "")):
                    for c, v in zip(cols, (i, pos, h, body, _tokens(body))):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "pos", "heading", "body", "n_tokens"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, pos int, heading string, body string, n_tokens bigint")


def within_budget(scored: DataFrame, budget: int) -> DataFrame:
    """scored(group, pos, score, n_tokens): best first until the budget would be passed; the first one always stays.

    Tokens are added up by score first, which tells the least score that can still be within the budget of a group: rows
    below it are dropped before any group meets in a task.
    """
    by_score = scored.groupBy("group", "score").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy("group").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    least = by_score.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("ahead") <= budget).groupBy(F.col("group").alias("g")).agg(F.min("score").alias("least"))
    scored = scored.join(least, F.col("group").eqNullSafe(F.col("g"))).where(F.col("score") >= F.col("least")).drop("g", "least")
    w = Window.partitionBy("group").orderBy(F.desc("score"), "pos")
    d = scored.withColumn("used", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return d.where((F.col("used") <= budget) | (F.col("rank") == 1))


def greedy_pack(items: DataFrame, budget: int) -> DataFrame:
    """items(group, id, score, n_tokens, kind) -> with ``tier`` must / should / excluded.

    Items are taken best first while they fit, oversized ones are skipped, and implementation takes half the budget at
    most: a sequence of decisions, made in one task per group. A group is the candidate list of one query, which
    earlier stages cut to a fixed length.
    """

    def pack(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["id"]))
        left, code = budget, budget // 2
        tier = []
        for r in rows:
            n = r["n_tokens"]
            if n <= left and (r["kind"] != "implementation" or n <= code):
                left -= n
                code -= n if r["kind"] == "implementation" else 0
                tier.append("must" if left >= budget // 2 else "should")
            else:
                tier.append("excluded")
        return pa.table({"group": [r["group"] for r in rows], "id": [r["id"] for r in rows], "tier": tier}, schema=pa.schema([("group", pa.string()), ("id", pa.string()), ("tier", pa.string())]))

    return items.groupBy("group").applyInArrow(pack, "group string, id string, tier string")
