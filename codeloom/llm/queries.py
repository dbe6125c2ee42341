"""Queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import handwritten, leakage, packing, percentiles, subjects, term_counts
from codeloom.runtime import driver_tables, work_area


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    (v,) = driver_tables(spark, d, "vocabularies")
    return term_counts.vocabulary_counts(v).marked().select("source_field", "item", F.explode("marks").alias("mark"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    (v,) = driver_tables(spark, d, "vocabularies")
    return term_counts.vocabulary_counts(v).counts()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    calls, limits = driver_tables(spark, d, "ch_tool_calls", "tool_limits")
    rows = p4_rows(spark, calls).where("n >= 30")
    stat = F.concat(F.lit("p"), F.col("p").cast("string"))
    limit = F.when(F.col("p") == 50, F.col("p50_limit_ms")).otherwise(F.col("p95_limit_ms"))
    return rows.join(limits, "tool_name").where(F.col("value") > limit).select("tool_name", "week", stat.alias("stat"))


def p4_rows(spark: SparkSession, calls: DataFrame) -> DataFrame:
    by = ["tool_name", "week"]
    counts = percentiles.value_counts(percentiles.tool_durations(calls), by, "duration_ms")
    return percentiles.percentiles(counts, by, [50, 95], work_area(spark, "percentiles"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50 and p95 of every group, small ones too."""
    (calls,) = driver_tables(spark, d, "ch_tool_calls")
    return p4_rows(spark, calls)


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = driver_tables(spark, d, "documents")
    return packing.pack(docs, "doc_id", "text")


def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: texts, tokens lost or doubled, windows above the capacity, texts cut without need."""
    (docs,) = driver_tables(spark, d, "documents")
    w = work_area(spark, "windows").put(packing.pack(docs, "doc_id", "text"), "windows")
    n = packing.token_counts(docs, "doc_id", "text").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_in"))
    out = w.agg(F.sum("n_tokens").alias("n_out"), F.count_if((F.col("piece") > 0) & (F.col("token_start") != F.col("piece") * packing.CAPACITY)).alias("n_gaps"))
    over = w.where("window_id IS NOT NULL").groupBy("window_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_over"))
    cut = w.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("piece").alias("last")).agg(F.count_if((F.col("n") <= packing.CAPACITY) & (F.col("last") > 0)).alias("n_cut"))
    one = lambda frame, c: frame.select(c).scalar()
    r = n.select("n_texts", (F.col("n_in") - one(out, "n_out")).alias("n_lost"), one(over, "n_over").alias("n_over"), one(cut, "n_cut").alias("n_cut"), one(out, "n_gaps").alias("n_gaps"))
    return r.select("n_texts", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lost", "n_over", "n_cut", "n_gaps")])


def p8_edited_copies(spark: SparkSession, d: str) -> DataFrame:
    """Recall: copies of every test item with each third word changed; (n_items, n_found)."""
    (items,) = driver_tables(spark, d, "eval_items")
    words = F.split(F.trim("text"), r"\s+")
    other = F.transform(words, lambda w, k: F.when(k % 3 == 2, F.lit("changed")).otherwise(w))
    copies = items.where("text IS NOT NULL").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Some notes come first. "), F.array_join(other, " "), F.lit(" More notes follow.")).alias("text"))
    found = leakage.found_leaks(copies, items).where("doc_id = item_id").select("item_id").distinct().withColumn("hit", F.lit(1))
    return items.where("text IS NOT NULL").select("item_id").distinct().join(found, "item_id", "left").agg(F.count("*").alias("n_items"), F.count("hit").alias("n_found"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_hand_written(*driver_tables(spark, d, "files", "file_samples"))


def p2_grounds(spark: SparkSession, d: str) -> DataFrame:
    """How many files each ground decided."""
    return handwritten.grounds(*driver_tables(spark, d, "files", "file_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found_leaks(*driver_tables(spark, d, "documents", "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*driver_tables(spark, d, "documents", "subjects", "doc_labels")).select("doc_id", "subject")


def p9_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Agreement with the labels of documents that neither train nor calibrate."""
    return subjects.held_out_agreement(*driver_tables(spark, d, "documents", "subjects", "doc_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_grounds, p4_found, p4_percentiles, p7_windows, p7_properties, p8_found, p8_edited_copies, p9_found, p9_held_out)}

_P1 = r"""
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, package ORDER BY built_at DESC) AS rn FROM vocabularies) WHERE rn = 1),
e AS (
  SELECT repo_id, package, 'term' AS source_field, regexp_replace(lower(u.term), '^\s+|\s+$', '', 'g') AS item, u.count AS c FROM (SELECT repo_id, package, unnest(terms) AS u FROM cur) WHERE u.term IS NOT NULL AND u.count > 0
  UNION ALL
  SELECT repo_id, package, 'identifier', regexp_replace(u.text, '^\s+|\s+$', '', 'g'), u.count FROM (SELECT repo_id, package, unnest(identifiers) AS u FROM cur) WHERE u.text IS NOT NULL AND u.count > 0),
t AS (SELECT source_field, item, sum(c)::BIGINT AS occurrences, count(DISTINCT (repo_id, package))::BIGINT AS records FROM e GROUP BY ALL)
"""

_P4 = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logged_at DESC) AS rn FROM ch_tool_calls) WHERE rn = 1),
m AS (SELECT lower(trim(tool_name)) AS tool_name, strftime(date_trunc('week', called_at), '%Y-%m-%d') AS week, list_sort(list(duration_ms)) AS v, count(*) AS n FROM cur WHERE duration_ms >= 0 GROUP BY ALL),
r AS (SELECT tool_name, week, n, p, v[((n - 1) * p // 100 + 1)::BIGINT] AS value FROM m, (SELECT unnest([50, 95]) AS p))
"""

ORACLES = {
    "p1_found": _P1 + """
SELECT source_field, item, 'rare' AS mark FROM t WHERE records < 3 OR occurrences < 10
UNION ALL SELECT source_field, item, 'common' FROM t WHERE records > 0.2 * (SELECT count(*) FROM cur)""",
    "p1_counts": _P1 + "SELECT source_field, item, occurrences, records FROM t",
    "p4_found": _P4 + """
SELECT tool_name, week, 'p' || p AS stat FROM r JOIN tool_limits l USING (tool_name)
WHERE n >= 30 AND value > CASE p WHEN 50 THEN p50_limit_ms ELSE p95_limit_ms END""",
    "p7_properties": "SELECT count(*)::BIGINT AS n_texts, 0::BIGINT AS n_lost, 0::BIGINT AS n_over, 0::BIGINT AS n_cut, 0::BIGINT AS n_gaps FROM documents",
    "p8_edited_copies": "SELECT count(DISTINCT item_id)::BIGINT AS n_items, count(DISTINCT item_id)::BIGINT AS n_found FROM eval_items WHERE text IS NOT NULL",
    "p4_percentiles": _P4 + "SELECT tool_name, week, p, n::BIGINT AS n, value FROM r",
}
