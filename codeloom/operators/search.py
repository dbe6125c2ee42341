"""Ranked lexical and vector search for a stated set of queries over all rows, in one pass over the texts.

Every text is tested against the distinct tokens of all queries in one expression; only (text, token) pairs that match
leave the scan, so the work follows the matches and not queries times texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as T
from codeloom.runtime import work_area

K1, B, AVERAGE, LEAST_IDF = 1.2, 0.75, 50.0, 0.05
#: Text queries a pass; more are searched block by block.
BLOCK = 500
#: Bytes of query vectors that are sent at once; more are searched block by block.
BLOCK_BYTES = 64_000_000


def tokens_of(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\x00-\x20_/.:]+", query.lower()) if t]


def weighted_tokens(query: str, synonyms: bool = False) -> dict[str, float]:
    """Distinct meaningful tokens of a query with weight 1, and words searched together with them with 0.4."""
    own = list(dict.fromkeys(t for t in tokens_of(query) if len(t.encode()) >= 3 and t not in T.COMMON_WORDS))
    out = dict.fromkeys(own, 1.0)
    if synonyms:
        for t in own:
            for group in T.SYNONYMS:
                if t in group:
                    for s in group:
                        out[s] = max(out.get(s, 0.0), 0.4)
    return out


def matches(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """docs(id, doc) with lower-case text -> (id, size, token, tf) of the tokens each holds, as substrings."""
    if not tokens:
        return docs.sparkSession.createDataFrame([], "id string, size int, token string, tf double")
    held = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.col("doc"), t))
    d = docs.select("id", "doc", F.explode(held).alias("token"))
    return d.select("id", F.octet_length("doc").alias("size"), "token", T.occurrences(F.col("doc"), F.col("token")).cast("double").alias("tf"))


def bm25(docs: DataFrame, queries: dict[str, str], synonyms: bool = False) -> DataFrame:
    """docs(id, doc) -> (query_id, id, score) of every text that holds a token of the query.

    Term frequencies count substrings, lengths bytes, and the inverse document frequency comes from the texts that match
    the query at all. Null texts match nothing; a query without meaningful tokens has no hits.
    """
    spark = docs.sparkSession
    names = sorted(queries)
    whole = None
    for a in range(0, max(1, len(names)), BLOCK):
        rows = [(q, t, w) for q in names[a : a + BLOCK] for t, w in weighted_tokens(queries[q], synonyms).items()]
        asked = F.broadcast(spark.createDataFrame(rows, "query_id string, token string, weight double"))  # a block of queries
        hit = matches(docs.where("doc IS NOT NULL"), sorted({t for _, t, _ in rows})).join(asked, "token")
        df = hit.groupBy("query_id", "token").agg(F.count("*").alias("df"))
        pool = hit.groupBy("query_id", "id").agg(F.lit(1).alias("x")).groupBy("query_id").agg(F.count("*").alias("n"))
        idf = df.join(pool, "query_id").select("query_id", "token", F.greatest(F.lit(LEAST_IDF), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
        s = hit.join(F.broadcast(idf), ["query_id", "token"])
        part = F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / AVERAGE))
        one = s.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def trigram(docs: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, id, score): of the query's trigrams (with repeats) those the text holds, over their number plus five."""
    out = []
    for q in sorted(queries):
        text = queries[q].lower()
        grams = [text[i : i + 3] for i in range(len(text) - 2)]
        if grams:
            n = F.size(F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("doc"), g)))
            out.append(F.struct(F.lit(q).alias("query_id"), (n / (len(grams) + 5)).alias("score")))
    if not out:
        return docs.sparkSession.createDataFrame([], "query_id string, id string, score double")
    d = docs.where("doc IS NOT NULL").select("id", F.explode(F.array(*out)).alias("x")).select("x.query_id", "id", "x.score")
    return d.where("score > 0")


def top(scored: DataFrame, k: int, order: tuple[str, ...] = ("id",), score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(a: DataFrame, b: DataFrame, k: int = 60, offset: int = 100) -> DataFrame:
    """Two ranked lists (query_id, id, rank) fused by reciprocal ranks; the second list's ranks start ``offset`` later."""
    parts = a.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("s")).unionByName(b.select("query_id", "id", (1.0 / (k + offset + F.col("rank"))).alias("s")))
    return parts.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def symbol_docs(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", F.lower(F.concat_ws(" ", "name", "path", "signature")).alias("doc"))


def hybrid(symbols: DataFrame, degrees: DataFrame, queries: dict[str, str], k: int = 10, pool: int = 200) -> DataFrame:
    """(query_id, id, score, rank): lexical and trigram score, cut to a pool, normalised, then signals in a fixed order.

    Signals: exact name +1, prefix +0.3, 0.15 ln(1 + callers); then tests x0.25 and scaffolding x0.4 unless asked for.
    """
    docs = symbol_docs(symbols)
    lex = bm25(docs, queries).withColumnRenamed("score", "lex")
    tri = trigram(docs, queries).withColumnRenamed("score", "tri")
    both = lex.join(tri, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("lex") + F.coalesce("tri", F.lit(0.0)), 9).alias("score"))
    first = top(both, pool).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).drop("rank")
    asked = F.broadcast(symbols.sparkSession.createDataFrame([(q, " ".join(tokens_of(t)), "test" in t.lower()) for q, t in queries.items()], "query_id string, q string, tests boolean"))
    d = first.join(symbols.select("id", "name", "path"), "id").join(degrees, "id", "left").join(asked, "query_id")
    name = F.lower("name")
    s = F.col("score") + F.when(F.array_contains(F.split("q", " "), name), 1.0).when(F.exists(F.split("q", " "), lambda t: F.startswith(name, t)), 0.3).otherwise(0.0)
    s = s + 0.15 * F.log(1 + F.coalesce("in_degree", F.lit(0)))
    s = F.when(paths.path_flag("test", F.col("path")) & ~F.col("tests"), s * 0.25).otherwise(s)
    s = F.when(paths.path_flag("scaffold", F.col("path")), s * 0.4).otherwise(s)
    return top(d.select("query_id", "id", F.round(s, 6).alias("score")), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, binary: bool = False) -> DataFrame:
    """vectors(id, v), queries(query_id, v) -> (query_id, id, score, rank) by cosine or sign-bit similarity.

    The stated queries are sent to the tasks in blocks of at most ``BLOCK_BYTES`` (a scan of the vectors a block). A task
    multiplies them with every Arrow batch and keeps the k best of each, so that the final ranking sees k rows a task and
    query. Missing vectors, zero norms and other lengths score 0.
    """
    spark: SparkSession = vectors.sparkSession
    area = work_area(spark, "queries")
    known = queries.where("v IS NOT NULL").select(F.col("query_id").cast("string").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    known = area.put(known, "queries")
    width, n = known.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-n * max(1, width) * 8 // BLOCK_BYTES))
    whole = None
    for a in range(blocks):
        block = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == a) if blocks > 1 else known
        sent = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in block.orderBy("query_id").collect()])

        def search(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            def unit(m):
                if binary:
                    return np.where(m > 0, 1.0, -1.0) / np.sqrt(m.shape[1])
                n = np.linalg.norm(m, axis=1, keepdims=True)
                return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

            if not sent.value:
                return
            names = [q for q, _ in sent.value]
            dim = len(sent.value[0][1])
            qm = unit(np.array([v if len(v) == dim else [0.0] * dim for _, v in sent.value], dtype=float))
            scores, ids = np.zeros((len(qm), 0)), np.zeros((len(qm), 0), np.int64)
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, 2048):
                    b = whole_batch.slice(at, 2048)
                    lists = b.column(1)
                    own, flat = b.column(0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
                    size = np.diff(lists.offsets.to_numpy())
                    ok = (size == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
                    sims = np.zeros((len(qm), len(own)))
                    if ok.any():
                        kept = flat[np.repeat(ok, np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0))]
                        s = qm @ unit(np.nan_to_num(kept.astype(float)).reshape(-1, dim)).T
                        sims[:, ok] = (s + 1) / 2 if binary else s
                    scores = np.concatenate([scores, np.round(sims, 6)], axis=1)
                    ids = np.concatenate([ids, np.broadcast_to(own, sims.shape)], axis=1)
                    best = np.lexsort((ids, -scores), axis=1)[:, :k]
                    scores, ids = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
            m = scores.shape[1]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), m), pa.string()), pa.array(ids.ravel(), pa.int64()), pa.array(scores.ravel())], ["query_id", "id", "score"])

        one = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL").mapInArrow(search, "query_id string, id bigint, score double")
        whole = one if whole is None else whole.unionByName(one)
    return top(whole, k)


def min_max(scored: DataFrame) -> DataFrame:
    """Scores moved to 0..1 per query; equal scores become 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def similar_symbols(symbols: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): symbols that share name words with a named one, weighted by how rare each word is,
    plus same kind and directory; joined on words, each name's first symbol by id stands for it."""
    s = symbols.select("id", "name", "kind", paths.dirname(F.col("path")).alias("dir"), F.array_distinct(T.split_identifier(F.col("name"))).alias("words"))
    base = s.where(F.col("name").isin(names)).groupBy(F.col("name").alias("query_id")).agg(F.min_by(F.struct("id", "kind", "dir", "words"), "id").alias("b"))
    words = s.select("id", "name", "kind", "dir", F.explode("words").alias("word"))
    n = words.groupBy("word").agg(F.count("*").alias("df"))
    asked = base.select("query_id", "b.*").select("query_id", F.col("id").alias("own"), F.col("kind").alias("own_kind"), F.col("dir").alias("own_dir"), F.explode("words").alias("word")).join(n, "word")
    hit = words.join(F.broadcast(asked), "word").where("id <> own")
    score = F.sum(1 / F.log(1.0 + F.col("df"))) + F.when(F.first("kind") == F.first("own_kind"), 0.08).otherwise(0.0) + F.when(F.first("dir") == F.first("own_dir"), 0.06).otherwise(0.0)
    return top(hit.groupBy("query_id", "id").agg(F.round(score, 6).alias("score")), k)


def hashed(id_: str = "id", parts: int = 100):
    """Whether the hash of an id is divisible by ``parts``."""
    return F.conv(F.substring(F.md5(F.col(id_).cast("binary")), 1, 8), 16, 10).cast("bigint") % parts == 0


def similar_of(symbols: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): as ``similar_symbols``, for every symbol whose id is in queries(id).

    Symbols with the same words share what words add to a score, so words are joined once for each distinct set of them.
    Kept of it are the sets that can be among the best k: kind and directory add 0.14 at most, and the k + 1 best sets hold
    k other symbols. Of a set and kind the first k + 1 ids stand for all, but for those of the query's directory, which are joined by it.
    """
    words = F.array_sort(F.array_distinct(T.split_identifier(F.col("name"))))
    s = symbols.select("id", "kind", paths.dirname(F.col("path")).alias("dir"), F.concat_ws(" ", words).alias("key")).where("key <> ''")
    area = work_area(symbols.sparkSession, "similar")
    s = area.put(s, "symbols")
    sets = s.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.explode(F.split("key", " ")).alias("word"))
    weight = sets.groupBy("word").agg((1 / F.log(1.0 + F.sum("n"))).alias("w"))
    q = s.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("kind").alias("own_kind"), F.col("dir").alias("own_dir"), F.col("key").alias("q"))
    q = area.put(q, "queries")
    asked = q.select("q").distinct().select("q", F.explode(F.split("q", " ")).alias("word")).join(weight, "word")
    base = asked.join(sets.select("key", "word"), "word").groupBy("q", "key").agg(F.sum("w").alias("base"))
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("base"), "key"))
    least = F.min(F.when(F.col("r") <= k + 1, F.col("base"))).over(Window.partitionBy("q"))
    base = area.put(base.withColumn("r", r).withColumn("least", least).where("base >= least - 0.15"), "base")
    # sets and kinds that hold the best symbols but for the directory, for all queries of the same words and kind
    heads = s.withColumn("r", F.row_number().over(Window.partitionBy("key", "kind").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    kinds = heads.select("key", "kind").distinct()
    alike = q.select("q", "own_kind").distinct().join(base.where("base >= least - 0.09").select("q", "key", "base"), "q").join(kinds, "key")
    alike = alike.withColumn("part", F.round(F.col("base") + F.when(F.col("kind") == F.col("own_kind"), 0.08).otherwise(0.0), 6))
    alike = alike.withColumn("place", F.rank().over(Window.partitionBy("q", "own_kind").orderBy(F.desc("part")))).where(F.col("place") <= k + 1)
    cols = ["query_id", "id", "base", "kind", "own_kind", "dir", "own_dir"]
    found = alike.join(heads.withColumnRenamed("kind", "k"), (F.col("k").eqNullSafe(F.col("kind"))) & (alike["key"] == heads["key"])).select("q", "own_kind", "id", "base", "kind", "dir")
    found = q.withColumnRenamed("own_kind", "ok").join(found.withColumnRenamed("q", "fq"), (F.col("fq") == F.col("q")) & F.col("ok").eqNullSafe(F.col("own_kind"))).select(*cols)
    near = q.join(s.withColumn("own_dir", F.col("dir")), "own_dir").join(base.select("q", "key", "base"), ["q", "key"]).select(*cols)
    found = found.unionByName(near).where("id <> query_id").dropDuplicates(["query_id", "id"])
    score = F.col("base") + F.when(F.col("kind") == F.col("own_kind"), 0.08).otherwise(0.0) + F.when(F.col("dir") == F.col("own_dir"), 0.06).otherwise(0.0)
    return top(found.select("query_id", "id", F.round(score, 6).alias("score")), k)


def trigram_index(symbols: DataFrame) -> DataFrame:
    """Inverted index (gram, id) of the distinct trigrams of name, path and signature; write it partitioned by a gram prefix."""
    return symbol_docs(symbols).select("id", F.explode(F.array_distinct(T.trigrams(F.col("doc")))).alias("gram"))


def indexed_contains(index: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Ids of docs(id, doc) that contain the text: those with all its trigrams by the index, then an exact recheck."""
    t = text.lower()
    grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
    if not grams:
        return docs.where(F.contains("doc", F.lit(t))).select("id")
    ids = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return docs.join(ids, "id").where(F.contains("doc", F.lit(t))).select("id")


def file_snippets(docs: DataFrame, queries: dict[str, str], k: int = 5) -> DataFrame:
    """docs(id, text) -> (query_id, id, line, score, rank): lines with the greatest share of the query's terms."""
    lines = docs.where("text IS NOT NULL").select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "body"))
    asked = []
    for q, t in sorted(queries.items()):
        terms = list(weighted_tokens(t))
        if terms:
            asked.append(F.struct(F.lit(q).alias("query_id"), (T.term_hits(F.col("body"), F.array(*[F.lit(x) for x in terms])) / len(terms)).alias("score")))
    d = lines.select("id", (F.col("line") + 1).alias("line"), F.explode(F.array(*asked)).alias("x")).select("x.query_id", "id", "line", F.round("x.score", 6).alias("score")).where("score > 0")
    return top(d, k, ("id", "line"))
