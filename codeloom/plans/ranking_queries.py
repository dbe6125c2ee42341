"""Queries over ranked search signals and bounded contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import bundle, graph, ranking, search, traverse
from codeloom.plans.base import GRAPH, ORACLES, query
from codeloom.plans.graph_queries import _UP, REFS, _bfs
from codeloom.plans.search_queries import _DOCS, DOC_QUERIES, SYMBOL_QUERIES, _bm25, _grams, _words, docs_of
from codeloom.runtime import driver_tables

HYBRID = f"({ORACLES['hybrid_symbols']})"
HINTED = {"h1": "flush the ledger in packages/ledger and .go files", "h2": "`services/` panel", "h3": "no hint here"}


@query(GRAPH + ", h(query_id, hint) AS (VALUES " + ", ".join(f"('{q}', '{h}')" for q, t in HINTED.items() for h in ranking.path_hints(t)) + ") SELECT query_id, id, count(*) * 1.25::DOUBLE AS boost FROM s JOIN h ON contains(lower(coalesce(path, '')), hint) GROUP BY ALL")
def path_hint_boosts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hint_boosts(graph.load_graph(spark, d).symbols, HINTED)


_OWNER = "CASE WHEN starts_with(parent_id, 'sym:') THEN regexp_extract(parent_id, '[^:]*$') ELSE parent_id END"


@query(GRAPH + f"SELECT {_OWNER} || '.' || name AS qualified, id FROM s WHERE kind = 'method' AND parent_id <> ''")
def qualified_methods(spark: SparkSession, d: str) -> DataFrame:
    return ranking.qualified_names(graph.load_graph(spark, d).symbols)


_HUB = " OR ".join([f"lower(name) IN ({', '.join(repr(u) for u in ranking.HUB_NAMES)})", *[f"((starts_with(lower(name), '{u}') OR ends_with(lower(name), '{u}')) AND length(name) <= {len(u) + 6})" for u in ranking.HUB_NAMES]])


@query(GRAPH + f"SELECT coalesce({_HUB}, false) AS is_hub, kind, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def hub_utilities(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    return s.groupBy(ranking.is_hub_utility(F.col("name")).alias("is_hub"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_bm25(DOC_QUERIES, _DOCS)}, g(query_id, gram, n) AS (VALUES {_grams(DOC_QUERIES)}),
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 50),
t AS (SELECT query_id, id, round(count(*) / (any_value(n) + 5), 9) AS score FROM dd JOIN g ON contains(doc, gram) GROUP BY query_id, id),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 50)
SELECT query_id, id, round(sum(s), 6) AS score, array_to_string(list_sort(list(DISTINCT reason)), '|') AS reasons FROM (SELECT query_id, id, 1.0 / (60 + rank) AS s, 'lexical' AS reason FROM a UNION ALL SELECT query_id, id, 1.0 / (160 + rank), 'trigram' FROM b) GROUP BY query_id, id""")
def rrf_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    a = search.top(search.bm25(docs, DOC_QUERIES).withColumn("score", F.round("score", 9)), 50).withColumn("reason", F.lit("lexical"))
    b = search.top(search.trigram(docs, DOC_QUERIES).withColumn("score", F.round("score", 9)), 50).withColumn("reason", F.lit("trigram"))
    return ranking.rrf_reasons(a, b).select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("reasons", "|").alias("reasons"))


_OWN = [(q, t, w) for q, x in DOC_QUERIES.items() for t, w in search.weighted_tokens(x).items()]
_WIDE = [(q, t, w) for q, x in DOC_QUERIES.items() for t, w in search.weighted_tokens(x, True).items()]


def _values(rows) -> str:
    return ", ".join(f"('{q}', '{t}', {w}::DOUBLE)" for q, t, w in rows)


@query(f"WITH t(query_id, term, weight) AS (VALUES {_values(_OWN)}, {_values(_WIDE)}), v AS (SELECT t.query_id, lower(i.u.text) AS term, 0.3::DOUBLE AS weight FROM (SELECT unnest(identifiers) AS u FROM vocabularies) i JOIN t ON contains(lower(i.u.text), t.term) WHERE i.u.text IS NOT NULL) SELECT query_id, term, max(weight) AS weight FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY ALL")
def merged_expansions(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the stated queries, their synonyms and vocabulary identifiers that hold one, each with its greatest weight."""
    (v,) = driver_tables(spark, d, "vocabularies")
    schema = "query_id string, term string, weight double"
    own, wide = spark.createDataFrame(_OWN, schema), spark.createDataFrame(_WIDE, schema)
    asked = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(t).alias("term")) for q, t, _ in _OWN + _WIDE])
    words = v.select(F.explode("identifiers").alias("u")).where("u.text IS NOT NULL").select(F.lower("u.text").alias("text")).distinct()
    held = words.select("text", F.explode(F.filter(asked, lambda a: F.contains(F.col("text"), a["term"]))).alias("a"))
    return ranking.merged_expansions(own, wide, held.select("a.query_id", F.col("text").alias("term"), F.lit(0.3).alias("weight")))


_STEM = "regexp_replace(regexp_replace(coalesce(path, ''), '\\\\', '/', 'g'), '(.)\\.[^./]*$', '\\1')"
_CONTEXT = f"replace(regexp_extract({_STEM}, '([^/]*/)?[^/]*$'), '/', ' ')"
_HUMAN = lambda c: f"array_to_string({_words(c)}, ' ')"


@query(GRAPH + f""", x AS (SELECT id, coalesce(name, '') AS own, {_HUMAN('name')} AS words, trim(coalesce(signature, '')) AS sig, {_HUMAN(_CONTEXT)} AS ctx FROM s),
y AS (SELECT *, CASE WHEN sig <> '' AND NOT regexp_matches(sig, '^[a-z_]+=\\S*$') THEN sig ELSE ctx END AS rest FROM x)
SELECT id, trim(concat_ws(' ', nullif(own, ''), CASE WHEN words <> '' AND words <> own THEN words END, nullif(rest, ''))) AS body FROM y""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    return s.select("id", ranking.embedding_text(F.col("name"), F.col("path"), F.col("signature")).alias("body"))


@query(f"SELECT id, score, rank FROM {HYBRID} WHERE query_id = 'b'")
def symbol_query(spark: SparkSession, d: str) -> DataFrame:
    return ranking.query(graph.load_graph(spark, d), SYMBOL_QUERIES["b"])


@query(GRAPH + f", x AS (SELECT id, lower(concat_ws(' ', name, path, signature)) AS doc FROM s), n AS (SELECT id, 'the ' || {_HUMAN('name')} AS purpose FROM s WHERE kind = 'class') SELECT x.id, lower(concat_ws(' ', doc, purpose, CASE WHEN purpose IS NOT NULL THEN 'alias' END)) AS doc FROM x LEFT JOIN n USING (id)")
def enriched_docs(spark: SparkSession, d: str) -> DataFrame:
    """Search texts with stored purposes (here made from the names of classes)."""
    from codeloom.functions import text as T

    s = graph.load_graph(spark, d).symbols
    stored = s.where("kind = 'class'").select("id", F.concat(F.lit("the "), T.humanize(F.col("name"))).alias("purpose"), F.array(F.lit("alias")).alias("aliases"))
    return ranking.with_enrichment(search.symbol_docs(s), stored)


_SYN = "regexp_matches(name, '(?i)" + paths.SYNTHETIC_ROUTE + "') OR starts_with(name, '@keyframes') OR regexp_matches(name, '^[.#]|^--') OR regexp_matches(lower(coalesce(path, '')), '\\.(css|scss|sass|less|md|mdx|html|htm|json|yaml|yml|toml)$') OR lower(coalesce(language, '')) IN ('css', 'scss')"


@query(GRAPH + f"SELECT coalesce({_SYN}, false) AS synthetic, language, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def synthetic_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = graph.load_graph(spark, d).symbols
    return s.groupBy(ranking.is_synthetic(F.col("name"), F.col("path"), F.col("language")).alias("synthetic"), "language").agg(F.count("*").alias("n"))


# bounded contexts --------------------------------------------------------------------------------------------------------

_TESTISH = "regexp_matches(a.name, '^(check|verify)')"
_CUT = lambda c, n: f"coalesce(array_to_string(list_sort(list({c}))[1:{n}], '|'), '')"


@query(GRAPH + f""", i AS (SELECT DISTINCT e.dst_id AS id, a.id AS other, {_TESTISH} AS test FROM e JOIN s a ON a.id = e.src_id WHERE e.kind IN {REFS}),
o AS (SELECT DISTINCT e.src_id AS id, b.id AS other FROM e JOIN s b ON b.id = e.dst_id WHERE e.kind = 'calls'), m AS (SELECT DISTINCT src_id AS file_id, dst_id AS other FROM e WHERE kind = 'imports'),
ci AS (SELECT id, {_CUT('other', 24)} AS callers FROM i GROUP BY 1), co AS (SELECT id, {_CUT('other', 24)} AS callees FROM o GROUP BY 1),
ct AS (SELECT id, {_CUT('other', 6)} AS tests FROM i WHERE test GROUP BY 1), cm AS (SELECT file_id, {_CUT('other', 24)} AS imports FROM m GROUP BY 1)
SELECT s.id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(imports, '') AS imports, coalesce(tests, '') AS tests
FROM s LEFT JOIN ci USING (id) LEFT JOIN co USING (id) LEFT JOIN ct USING (id) LEFT JOIN cm ON cm.file_id = 'file:' || s.repo_id || ':' || s.path""")
def context_bundle(spark: SparkSession, d: str) -> DataFrame:
    b = bundle.context_bundles(graph.load_graph(spark, d), is_test=F.col("src_name").rlike("^(check|verify)"))
    return b.select("id", *[F.array_join(c, "|").alias(c) for c in ("callers", "callees", "imports", "tests")])


@query(GRAPH + """, t AS (SELECT DISTINCT file_id, regexp_split_to_array(head, '\\r\\n|\\n|\\r') AS l FROM file_samples WHERE head IS NOT NULL),
x AS (SELECT s.id, l, greatest(coalesce(line_start, 1), 1) AS a, coalesce(line_end, 0) AS b FROM s JOIN t ON t.file_id = 'file:' || s.repo_id || ':' || s.path),
y AS (SELECT id, l, a, least(CASE WHEN b <= 0 OR b > len(l) THEN len(l) ELSE greatest(a, b) END - a + 1, 40) AS n FROM x WHERE a <= len(l))
SELECT id, array_to_string(l[a:a + n - 1], chr(10)) AS source, n::BIGINT AS n_shown FROM y""")
def source_slices(spark: SparkSession, d: str) -> DataFrame:
    (samples,) = driver_tables(spark, d, "file_samples")
    return bundle.source_slices(graph.load_graph(spark, d).symbols, samples.select("file_id", F.col("head").alias("text")).distinct())


@query(GRAPH + f""", h AS (SELECT * FROM {HYBRID}), k AS (SELECT src_id, dst_id FROM e WHERE kind = 'calls'),
n AS (SELECT query_id, rank, score, dst_id AS id FROM h JOIN k ON src_id = h.id WHERE rank <= 4 UNION ALL SELECT query_id, rank, score, src_id FROM h JOIN k ON dst_id = h.id WHERE rank <= 4),
b AS (SELECT query_id, id, min(rank)::INT AS seed_rank, round(arg_min(score, rank) * 0.9, 6) AS score FROM n WHERE id IN (SELECT id FROM s) AND (query_id, id) NOT IN (SELECT query_id, id FROM h) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, id)::INT AS place FROM b) SELECT * FROM p WHERE place <= 12""")
def dependency_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES)
    return bundle.dependency_neighbors(g, hits)


@query(GRAPH + _bfs(_UP, "SELECT id AS seed, id AS node FROM sdk_symbols", 1) + ", m AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY path, node)::INT AS place FROM r JOIN s ON s.id = r.node WHERE depth = 1 AND kind IN ('function','method','class','variable')) SELECT * FROM m WHERE place <= 8")
def must_update(spark: SparkSession, d: str) -> DataFrame:
    g = graph.load_graph(spark, d)
    (sdk,) = driver_tables(spark, d, "sdk_symbols")
    return bundle.must_update(traverse.impact(g, sdk.select(F.col("id").alias("seed")), 1), g.symbols)


@query(GRAPH + f"SELECT id, NOT list_has_any(string_split(lower(replace(coalesce(path, ''), chr(92), '/')), '/'), {bundle.PACK_EXCLUDE}) AS packable, contains(lower(coalesce(path, '')), 'ledger') AS wanted FROM f")
def pack_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that contexts may be packed from, and those of a wanted path."""
    return graph.load_graph(spark, d).files.select("id", bundle.packable(F.col("path")).alias("packable"), bundle.path_matches(F.col("path"), "Ledger").alias("wanted"))


@query(GRAPH + ", u AS (SELECT repo_id, name FROM s WHERE kind IN ('function','method') AND length(name) >= 6 GROUP BY ALL HAVING count(*) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS r FROM u) SELECT repo_id, name FROM r WHERE r <= 40")
def bench_targets(spark: SparkSession, d: str) -> DataFrame:
    return bundle.bench_targets(graph.load_graph(spark, d).symbols)


GOLDEN = {"a": ["panel", "zzz"], "b": ["ledger"], "c": ["index"], "d": ["/"]}


@query(GRAPH + f""", c(query_id, needle) AS (VALUES {", ".join(f"('{q}', '{n}')" for q, ns in GOLDEN.items() for n in ns)}), h AS (SELECT query_id, path, rank FROM {HYBRID} JOIN s USING (id)),
m AS (SELECT c.query_id, needle, min(rank) FILTER (contains(lower(path), needle)) AS first FROM c LEFT JOIN h USING (query_id) GROUP BY ALL)
SELECT query_id, count(*) FILTER (first IS NULL) = 0 AS passed, coalesce(min(first), 0)::INT AS first_rank, (count(*) FILTER (first IS NULL))::BIGINT AS n_missing FROM m GROUP BY 1""")
def golden_suite(spark: SparkSession, d: str) -> DataFrame:
    """Stated queries and texts that the paths of their hits must contain."""
    g = graph.load_graph(spark, d)
    hits = search.hybrid(g.symbols, graph.in_degrees(g.edges), SYMBOL_QUERIES).join(g.symbols.select("id", "path"), "id")
    cases = spark.createDataFrame([(q, n) for q, ns in GOLDEN.items() for n in ns], "query_id string, needle string")
    return bundle.golden_cases(hits.select("query_id", "path", "rank"), cases)
