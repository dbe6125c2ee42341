"""Queries over texts, vectors, tool calls, rules and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.operators import contracts, evaluate, graph, markdown, rules, search, usage
from codeloom.operators.current import latest
from codeloom.plans.base import GRAPH, latest_sql, query
from codeloom.plans.graph_queries import matches
from codeloom.runtime import driver_tables

# stated queries
DOC_QUERIES = {"ml": "training run gradient of the model", "money": "invoice payment refund", "ops": "container rollout artifact", "care": "blood pressure surgery"}
SYMBOL_QUERIES = {"a": "resolveSignal panel", "b": "flush ledger writer", "c": "index cache/fetch", "d": "split invoice"}


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = driver_tables(spark, d, "documents")
    return documents.select(F.col("doc_id").cast("string").alias("id"), F.lower("text").alias("doc"), "text")


def _tokens(queries: dict[str, str], synonyms: bool = False) -> str:
    return ", ".join(f"('{q}', '{t}', {w}::DOUBLE)" for q, x in sorted(queries.items()) for t, w in search.weighted_tokens(x, synonyms).items())


def _bm25(queries: dict[str, str], docs: str, synonyms: bool = False) -> str:
    return f"""q(query_id, token, weight) AS (VALUES {_tokens(queries, synonyms)}), dd AS ({docs}),
m AS (SELECT q.query_id, dd.id, q.token, weight, strlen(doc) AS size, (strlen(doc) - strlen(replace(doc, token, ''))) / strlen(token) AS tf FROM dd JOIN q ON contains(dd.doc, q.token)),
df AS (SELECT query_id, token, count(*) AS df FROM m GROUP BY ALL), pool AS (SELECT query_id, count(DISTINCT id) AS n FROM m GROUP BY 1),
idf AS (SELECT query_id, token, greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df JOIN pool USING (query_id)),
bm AS (SELECT m.query_id, m.id, sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 50.0))) AS score FROM m JOIN idf USING (query_id, token) GROUP BY ALL)"""


_DOCS = "SELECT doc_id::VARCHAR AS id, lower(text) AS doc FROM documents WHERE text IS NOT NULL"


@query(f"WITH {_bm25(DOC_QUERIES, _DOCS)} SELECT query_id, id, round(score, 6) AS score FROM bm")
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(docs_of(spark, d), DOC_QUERIES).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(DOC_QUERIES, _DOCS, True)}, r AS (SELECT query_id, id, round(score, 6) AS score FROM bm), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r) SELECT * FROM o WHERE rank <= 10")
def synonym_search(spark: SparkSession, d: str) -> DataFrame:
    s = search.bm25(docs_of(spark, d), DOC_QUERIES, synonyms=True)
    return search.top(s.withColumn("score", F.round("score", 6)), 10)


def _grams(queries: dict[str, str]) -> str:
    return ", ".join(f"('{q}', '{x.lower()[i : i + 3]}', {len(x) - 2})" for q, x in sorted(queries.items()) for i in range(len(x) - 2))


@query(f"WITH g(query_id, gram, n) AS (VALUES {_grams(DOC_QUERIES)}), dd AS ({_DOCS}) SELECT query_id, id, round(count(*) / (any_value(n) + 5), 6) AS score FROM dd JOIN g ON contains(doc, gram) GROUP BY query_id, id")
def trigram_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.trigram(docs_of(spark, d), DOC_QUERIES).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25(DOC_QUERIES, _DOCS)}, g(query_id, gram, n) AS (VALUES {_grams(DOC_QUERIES)}),
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 100),
t AS (SELECT query_id, id, round(count(*) / (any_value(n) + 5), 9) AS score FROM dd JOIN g ON contains(doc, gram) GROUP BY query_id, id),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 100)
SELECT query_id, id, round(sum(s), 6) AS score FROM (SELECT query_id, id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT query_id, id, 1.0 / (160 + rank) FROM b) GROUP BY query_id, id""")
def rrf_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    a = search.top(search.bm25(docs, DOC_QUERIES).withColumn("score", F.round("score", 9)), 100)
    b = search.top(search.trigram(docs, DOC_QUERIES).withColumn("score", F.round("score", 9)), 100)
    return search.rrf(a, b).select("query_id", "id", F.round("score", 6).alias("score"))


_SYMDOCS = "SELECT id, lower(concat_ws(' ', name, path, signature)) AS doc FROM s"
_ASKED = ", ".join(f"('{q}', [{', '.join(repr(t) for t in search.tokens_of(x))}], {'true' if 'test' in x.lower() else 'false'})" for q, x in sorted(SYMBOL_QUERIES.items()))


@query(GRAPH + f""", {_bm25(SYMBOL_QUERIES, _SYMDOCS)}, g(query_id, gram, n) AS (VALUES {_grams(SYMBOL_QUERIES)}), asked(query_id, toks, tests) AS (VALUES {_ASKED}),
t AS (SELECT query_id, id, count(*) / (any_value(n) + 5) AS score FROM dd JOIN g ON contains(doc, gram) GROUP BY query_id, id),
x AS (SELECT bm.query_id, bm.id, round(bm.score + coalesce(t.score, 0), 9) AS score FROM bm LEFT JOIN t USING (query_id, id)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM x) WHERE r <= 200),
n AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS score FROM p),
deg AS (SELECT dst_id AS id, count(*) AS c FROM e WHERE kind = 'calls' GROUP BY 1),
y AS (SELECT n.query_id, n.id, s.path, tests, n.score + CASE WHEN list_contains(toks, lower(s.name)) THEN 1.0 WHEN len(list_filter(toks, lambda z: starts_with(lower(s.name), z))) > 0 THEN 0.3 ELSE 0 END + 0.15 * ln(1 + coalesce(c, 0)) AS v
  FROM n JOIN s USING (id) LEFT JOIN deg USING (id) JOIN asked USING (query_id)),
w AS (SELECT query_id, id, round(v * CASE WHEN {matches('path', paths.TEST)} AND NOT tests THEN 0.25 ELSE 1 END * CASE WHEN {matches('path', paths.SCAFFOLD)} THEN 0.4 ELSE 1 END, 6) AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM w)
SELECT query_id, id, score, rank FROM o WHERE rank <= 10""")
def hybrid_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    return search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES).select("query_id", "id", "score", "rank")


@query(GRAPH + ", x AS (SELECT id, lower(concat_ws(' ', name, path, signature)) AS doc FROM s) SELECT id FROM x WHERE contains(doc, 'hledger')")
def indexed_contains(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    return search.indexed_contains(search.trigram_index(s), search.symbol_docs(s), "hLedger")


def _words(c: str) -> str:
    s = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({s}), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$'))"


@query(GRAPH + f""", i AS (SELECT name, kind, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT unnest({_words('name')}) AS term FROM s)
SELECT 'identifier' AS field, name AS item, sum(n)::BIGINT AS n, arg_min(kind, (-n, kind)) AS kind FROM i GROUP BY name
UNION ALL SELECT 'term', term, count(*)::BIGINT, NULL FROM w GROUP BY term""")
def symbol_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    i = s.groupBy("name", "kind").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("n"), F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))
    w = s.select(F.explode(T.split_identifier(F.col("name"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return i.select(F.lit("identifier").alias("field"), F.col("name").alias("item"), "n", "kind").unionByName(w.select(F.lit("term").alias("field"), "item", "n", F.lit(None).cast("string").alias("kind")))


@query(GRAPH + f""", w0 AS (SELECT id, kind, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, list_distinct({_words('name')}) AS words FROM s),
w AS (SELECT id, kind, dir, unnest(words) AS word FROM w0), n AS (SELECT word, count(*) AS df FROM w GROUP BY 1),
a AS (SELECT id AS query_id, kind AS k, dir AS d, word FROM w WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 100 = 0),
h AS (SELECT query_id, w.id, round(sum(1 / ln(1.0 + df)) + CASE WHEN any_value(w.kind) = any_value(k) THEN 0.08 ELSE 0 END + CASE WHEN any_value(dir) = any_value(d) THEN 0.06 ELSE 0 END, 6) AS score
  FROM a JOIN w USING (word) JOIN n USING (word) WHERE w.id <> query_id GROUP BY query_id, w.id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM h) SELECT query_id, id, score, rank FROM o WHERE rank <= 10""")
def similar_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols like each symbol whose hashed id is divisible by 100, among all symbols."""
    s = graph.load_graph(spark, d).symbols
    return search.similar_of(s, s.where(search.hashed()))


@query(GRAPH + f""", h AS (SELECT *, CASE WHEN lower(name) = 'ledger' THEN 0 WHEN lower(name) LIKE '%.ledger' THEN 1 ELSE 2 END AS tier FROM s WHERE contains(lower(name), 'ledger')),
b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY repo_id) AS best FROM h) WHERE tier = best),
o AS (SELECT repo_id, id, name, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN {matches('path', paths.FIXTURE)} THEN 1 ELSE 0 END, path, name, id)::INT AS rank FROM b) SELECT * FROM o WHERE rank <= 5""")
def group_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.group_search(graph.load_graph(spark, d).symbols, "Ledger")


_LINES = "l AS (SELECT doc_id AS file, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS content, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1)::INT AS line FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH l AS (SELECT doc_id::VARCHAR AS id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS body, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1)::INT AS line FROM documents WHERE text IS NOT NULL),
q(query_id, token, n) AS (VALUES {", ".join(f"('{q}', '{t}', {len(search.weighted_tokens(x))})" for q, x in sorted(DOC_QUERIES.items()) for t in search.weighted_tokens(x))}),
h AS (SELECT query_id, id, line, round(count(*) / any_value(n), 6) AS score FROM l JOIN q ON contains(lower(body), token) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, line)::INT AS rank FROM h) SELECT query_id, id, line, score, rank FROM o WHERE rank <= 5""")
def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    return search.file_snippets(docs_of(spark, d), DOC_QUERIES)


# vectors ---------------------------------------------------------------------------------------------------------------


def vectors_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    (e,) = driver_tables(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.where("id % 100 = 0").select(F.col("id").cast("string").alias("query_id"), "v")


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.id::VARCHAR AS query_id, v.id, {score} AS score FROM v, v q WHERE q.id % 100 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c)"


@query("WITH " + _VEC.format(score="round(list_cosine_similarity(v.v, q.v), 6)") + " SELECT query_id, id, score, rank FROM o WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(*vectors_of(spark, d)).select("query_id", "id", "score", "rank")


_SAME = "round(1 - list_sum(list_transform(list_zip(v.v, q.v), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) / 64.0, 6)"


@query("WITH " + _VEC.format(score=_SAME) + " SELECT query_id, id, score, rank FROM o WHERE rank <= 10")
def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(*vectors_of(spark, d), binary=True).select("query_id", "id", "score", "rank")


@query("WITH " + _VEC.format(score="round(list_cosine_similarity(v.v, q.v), 6)") + ", " + _VEC.format(score=_SAME).replace("v AS (", "v2 AS (", 1).replace(" c AS ", " c2 AS ").replace("FROM v, v q", "FROM v, v q").replace(" o AS ", " o2 AS ").replace("FROM c)", "FROM c2)")
       + " SELECT query_id, id, round(sum(s), 6) AS score FROM (SELECT query_id, id, 1.0 / (60 + rank) AS s FROM o WHERE rank <= 10 UNION ALL SELECT query_id, id, 1.0 / (160 + rank) FROM o2 WHERE rank <= 10) GROUP BY ALL")
def vector_rrf(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors_of(spark, d)
    return search.rrf(search.nearest(v, q), search.nearest(v, q, binary=True)).select("query_id", "id", F.round("score", 6).alias("score"))


# tool calls, runs and memories ---------------------------------------------------------------------------------------------


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    (calls,) = driver_tables(spark, d, "ch_tool_calls")
    cur = latest(calls, ["id"], "logged_at", ["run_id", "called_at", "tool_name", "duration_ms", "error"])
    return cur.select("id", F.col("run_id").alias("session"), F.col("called_at").alias("ts"), F.lower(F.trim("tool_name")).alias("tool"), F.when(F.col("duration_ms") >= 0, F.col("duration_ms")).alias("latency"), F.col("error").isNotNull().alias("failed"))


_CALLS = f"c AS (SELECT id, run_id AS session, called_at AS ts, lower(trim(tool_name)) AS tool, CASE WHEN duration_ms >= 0 THEN duration_ms END AS latency, error IS NOT NULL AS failed, step_index FROM ({latest_sql('ch_tool_calls', 'logged_at')}))"


@query(f"WITH {_CALLS} SELECT tool, count(*)::BIGINT AS n_calls, (count(*) FILTER (failed))::BIGINT AS n_errors, sum(latency)::BIGINT AS total_ms, floor(sum(latency) / count(latency))::BIGINT AS avg_ms, min(latency) AS min_ms, max(latency) AS max_ms FROM c GROUP BY 1")
def usage_tools(spark: SparkSession, d: str) -> DataFrame:
    return usage.tool_report(calls_of(spark, d))


@query(f"""WITH {_CALLS} SELECT session, count(*)::BIGINT AS n_calls, (count(*) FILTER (failed))::BIGINT AS n_errors, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT tool)::BIGINT AS n_tools,
arg_max(tool, (ts, tool)) AS last_tool, coalesce(sum(latency), 0)::BIGINT AS total_ms FROM c WHERE session <> '' GROUP BY 1""")
def usage_sessions(spark: SparkSession, d: str) -> DataFrame:
    return usage.session_report(calls_of(spark, d))


@query(f"""WITH {_CALLS}, r AS (SELECT id AS run_id, arg_max(status, created_at) AS status FROM ch_runs GROUP BY 1)
SELECT run_id, status, string_agg(tool, '>' ORDER BY step_index, ts, c.id) AS trace, count(*)::BIGINT AS n_steps, (count(*) FILTER (failed))::BIGINT AS n_errors FROM c JOIN r ON r.run_id = c.session GROUP BY ALL""")
def run_traces(spark: SparkSession, d: str) -> DataFrame:
    runs, calls = driver_tables(spark, d, "ch_runs", "ch_tool_calls")
    cur = latest(calls, ["id"], "logged_at", ["run_id", "step_index", "called_at", "tool_name", "error"]).withColumn("tool_name", F.lower(F.trim("tool_name")))
    return usage.run_traces(latest(runs, ["id"], "created_at", ["status"]), cur)


@query("""WITH r AS (SELECT DISTINCT id, created_at, task, confidence FROM ch_runs WHERE task IS NOT NULL), l AS (SELECT * FROM r ORDER BY created_at DESC, id LIMIT 200),
h AS (SELECT id, round(((CASE WHEN contains(lower(task), 'ledger') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(task), 'filter') THEN 1 ELSE 0 END)) / 2, 6) AS score, confidence AS weight FROM l)
SELECT * FROM h WHERE score > 0 ORDER BY score DESC, weight DESC, id LIMIT 10""")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    (runs,) = driver_tables(spark, d, "ch_runs")
    rows = runs.where("task IS NOT NULL").select("id", F.col("created_at").alias("ts"), F.col("task").alias("text"), F.col("confidence").alias("weight")).distinct()
    return usage.search_memory(rows, "ledger filter")


@query("""WITH o AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000, true)::INT AS fresh FROM events),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM o)
SELECT user_id AS "user", session, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x GROUP BY ALL""")
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    (e,) = driver_tables(spark, d, "events")
    return usage.sessions(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), "ts"), 3600)


@query(f"""WITH {_CALLS}, m AS (SELECT tool, list_sort(list(latency)) AS v, count(*) AS n FROM c WHERE latency IS NOT NULL GROUP BY 1) SELECT tool, p, v[((n - 1) * p // 100 + 1)::BIGINT] AS value FROM m, (SELECT unnest([50, 95]) AS p)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.index_percentile(calls_of(spark, d), ["tool"], "latency", [50, 95])


# rules and texts -------------------------------------------------------------------------------------------------------------


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


#: Lines of the samples of files, and their statements (what stands between semicolons, braces and line ends).
_SAMPLES = "(SELECT DISTINCT file_id AS file, head FROM file_samples WHERE file_id IS NOT NULL AND head IS NOT NULL)"
_ENDS, _STATEMENT_ENDS = r"\r\n|\n|\r", r"[;{}]|\r\n|\n|\r"


def sample_lines_sql(ends: str) -> str:
    return f"l AS (SELECT file, unnest(regexp_split_to_array(head, '{ends}')) AS content, generate_subscripts(regexp_split_to_array(head, '{ends}'), 1)::INT AS line FROM {_SAMPLES})"


def sample_lines(spark: SparkSession, d: str, ends: str = _ENDS) -> DataFrame:
    (samples,) = driver_tables(spark, d, "file_samples")
    return rules.lines_of(samples.where("file_id IS NOT NULL").select("file_id", "head").distinct(), "file_id", "head", ends)


def _scan(rule_set, comments: bool, lines: str | None = None) -> str:
    text = "content" if comments else "regexp_replace(content, '(^|\\s)(//|#).*$', '')"
    flat = "\n UNION ALL ".join(f"SELECT file, line, '{r}' AS rule, '{s}' AS severity FROM l WHERE regexp_matches({text}, '{quoted(p)}')" for r, s, p in rule_set)
    return f"{lines or _LINES}, x AS ({flat})"


_WEIGHT = "CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def findings_of(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = driver_tables(spark, d, "documents")
    return rules.scan_lines(rules.lines_of(documents, "doc_id", "text"), rules.NOTE_RULES, comments=True)


@query(f"WITH {_scan(rules.NOTE_RULES, True)} SELECT file, line, rule, severity FROM x")
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return findings_of(spark, d)


@query(f"WITH {_scan(rules.SECURITY_RULES, False, sample_lines_sql(_ENDS))} SELECT file, line, rule, severity FROM x")
def security_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan_lines(sample_lines(spark, d), rules.SECURITY_RULES)


@query(f"WITH {_scan(rules.NOTE_RULES, True)} SELECT file, line, rule, severity, row_number() OVER (PARTITION BY file ORDER BY {_WEIGHT} DESC, rule, line)::INT AS rank FROM x")
def finding_rank(spark: SparkSession, d: str) -> DataFrame:
    return rules.rank_findings(findings_of(spark, d))


@query(f"WITH {_scan(rules.NOTE_RULES, True)}, s AS (SELECT file, sum({_WEIGHT})::BIGINT AS score FROM x GROUP BY 1) SELECT file, score, CASE WHEN score >= 12 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS risk FROM s")
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    return rules.risk_scores(findings_of(spark, d))


@query(f"WITH {sample_lines_sql(_STATEMENT_ENDS)}, w AS (SELECT file, line, content, max(CASE WHEN regexp_matches(content, '{rules.LOOP}') THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loop_line FROM l) SELECT file, line, loop_line FROM w WHERE regexp_matches(content, '{rules.CALL}') AND line - loop_line <= 12")
def loop_calls(spark: SparkSession, d: str) -> DataFrame:
    return rules.loop_calls(sample_lines(spark, d, _STATEMENT_ENDS))


_SECRET = T.SECRET.replace("'", "''")


@query(f"SELECT id, regexp_replace(args_json, '{_SECRET}', '\\1[REDACTED]', 'g') AS args, (strlen(args_json) + 3) // 4 AS n_tokens, substring(sha256(result_summary), 1, 16) AS hash FROM ({latest_sql('ch_tool_calls', 'logged_at')})")
def redacted_calls(spark: SparkSession, d: str) -> DataFrame:
    (calls,) = driver_tables(spark, d, "ch_tool_calls")
    cur = latest(calls, ["id"], "logged_at", ["args_json", "result_summary"])
    return cur.select("id", T.redact(F.col("args_json")).alias("args"), T.estimate_tokens(F.col("args_json")).alias("n_tokens"), T.short_hash(F.col("result_summary")).alias("hash"))


_HTML = r"regexp_replace(regexp_replace(text, '(?is)<(script|style|nav|footer|header|svg)\b[^>]*>.*?</(script|style|nav|footer|header|svg)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"WITH h AS (SELECT doc_id, replace(replace(replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS t FROM documents) SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS body FROM h")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = driver_tables(spark, d, "documents")
    return documents.select("doc_id", T.html_to_text(F.col("text")).alias("body"))


@query()
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = driver_tables(spark, d, "documents")
    return markdown.chunks(documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"))


@query("""WITH t AS (SELECT doc_kind AS "group", doc_id AS pos, (strlen(text) // 4)::BIGINT AS n_tokens, ((length(text) - length(replace(lower(text), 'ledger', ''))) // 6)::BIGINT AS score FROM documents WHERE text IS NOT NULL AND contains(lower(text), 'ledger')),
w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY "group" ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, pos)::INT AS rank FROM t)
SELECT "group", pos, score, n_tokens, used, rank FROM w WHERE used <= 2000 OR rank = 1""")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = driver_tables(spark, d, "documents")
    low = F.lower("text")
    c = documents.where("text IS NOT NULL").where(F.contains(low, F.lit("ledger")))
    s = c.select(F.col("doc_kind").alias("group"), F.col("doc_id").alias("pos"), F.expr("octet_length(text) div 4").cast("bigint").alias("n_tokens"), F.expr("(length(text) - length(replace(lower(text), 'ledger', ''))) div 6").cast("bigint").alias("score"))
    return markdown.within_budget(s, 2000)


@query(GRAPH + ", c AS (SELECT DISTINCT repo_id, src_id AS path, regexp_extract(dst_id, '^mod:[^:]*:(.*)$', 1) AS key FROM e WHERE kind = 'imports' AND dst_id LIKE 'mod:%') SELECT 'module' AS kind, key, count(DISTINCT repo_id)::BIGINT AS n_repos, count(*)::BIGINT AS n_paths FROM c GROUP BY key HAVING count(DISTINCT repo_id) >= 2 OR count(*) >= 2")
def contract_links(spark: SparkSession, d: str) -> DataFrame:
    return contracts.links(contracts.import_contracts(graph.load_graph(spark, d)))


# evaluation ---------------------------------------------------------------------------------------------------------------

_IDEAL = "list_sum(list_transform(range(1, least({n}, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1)))"


@query(f"""WITH {_bm25(DOC_QUERIES, _DOCS)},
r AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 10),
topics(query_id, subject) AS (VALUES ('ml', 'machine_learning'), ('money', 'finance'), ('ops', 'delivery'), ('care', 'health')),
want AS (SELECT DISTINCT query_id, doc_id::VARCHAR AS id FROM doc_labels JOIN topics USING (subject)), w AS (SELECT query_id, count(*) AS n FROM want GROUP BY 1),
h AS (SELECT query_id, min(rank) AS first, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN want USING (query_id, id) GROUP BY 1)
SELECT w.query_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_1, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_5, CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_10,
  round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(found, 0) / n, 6) AS recall,
  round(CASE WHEN found > 0 THEN dcg / {_IDEAL.format(n='found')} ELSE 0 END, 6) AS ndcg_found, round(CASE WHEN found > 0 THEN dcg / {_IDEAL.format(n='n')} ELSE 0 END, 6) AS ndcg
FROM w LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    (labels,) = driver_tables(spark, d, "doc_labels")
    ranked = search.top(search.bm25(docs_of(spark, d), DOC_QUERIES).withColumn("score", F.round("score", 9)), 10)
    of = F.create_map(*[F.lit(x) for kv in {"machine_learning": "ml", "finance": "money", "delivery": "ops", "health": "care"}.items() for x in kv])
    want = labels.select(F.try_element_at(of, F.col("subject")).alias("query_id"), F.col("doc_id").cast("string").alias("id")).where("query_id IS NOT NULL")
    return evaluate.rank_metrics(ranked, want)


@query(GRAPH + """, t AS (SELECT DISTINCT dst_id AS callee, src_id AS item FROM e WHERE kind = 'calls' AND dst_id LIKE 'sym:%'), g AS (SELECT DISTINCT t.callee, t.item FROM t JOIN e ON e.kind = 'calls' AND e.src_id = t.item AND e.dst_id = t.callee WHERE e.confidence >= 0.8),
c AS (SELECT t.callee, count(*) AS n_t, count(g.item) AS tp FROM t LEFT JOIN g USING (callee, item) GROUP BY 1)
SELECT callee, round(CASE WHEN tp > 0 THEN 1.0 ELSE 0 END, 6)::DOUBLE AS precision, round(tp / n_t, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (n_t + tp) ELSE 0 END, 6) AS f1 FROM c""")
def caller_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Callers by edges of confidence 0.8 and more against all callers."""
    e = graph.load_graph(spark, d).edges.where("kind = 'calls' AND dst_id LIKE 'sym:%'")
    truth = e.select(F.col("dst_id").alias("callee"), F.col("src_id").alias("item"))
    return evaluate.set_accuracy(truth, e.where("confidence >= 0.8").select(F.col("dst_id").alias("callee"), F.col("src_id").alias("item")), "callee")
