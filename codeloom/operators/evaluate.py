"""Retrieval quality and set accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """ranked(query_id, id, rank), relevant(query_id, id) -> per query: hit at 1, 5 and 10, reciprocal rank, recall, nDCG
    over the relevant ones found (``ndcg_found``) and over all relevant ones (``ndcg``)."""
    want = relevant.select("query_id", "id").distinct()
    hits = ranked.join(want, ["query_id", "id"], "left_semi").where(F.col("rank") <= k)
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    d = want.groupBy("query_id").agg(F.count("*").alias("n_relevant")).join(per, "query_id", "left")
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    at = lambda n: F.when(F.col("first") <= n, 1.0).otherwise(0.0)
    found = F.coalesce("found", F.lit(0))
    return d.select(
        "query_id", at(1).alias("hit_1"), at(5).alias("hit_5"), at(10).alias("hit_10"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(found / F.col("n_relevant"), 6).alias("recall"), F.round(F.when(found > 0, F.col("dcg") / ideal(F.col("found"))).otherwise(0.0), 6).alias("ndcg_found"),
        F.round(F.when(found > 0, F.col("dcg") / ideal(F.col("n_relevant"))).otherwise(0.0), 6).alias("ndcg"),
    )


def self_retrieval(symbols: DataFrame) -> DataFrame:
    """(repo_id, n_queries, hit_1, hit_10, mrr): of each repository, all functions and methods whose name is unique among
    those of the repository, each searched there by the words of its name.

    Every shared word adds to a score, then fewer words and the lesser id come first. So none scores more than a symbol
    with all words asked for, and before the one sought are those with just its words and a lesser id: its rank is
    counted from the symbols with equal words, without a row for any other. A name without words finds nothing.
    """
    words = F.array_sort(F.array_distinct(T.split_identifier(F.col("name"))))
    s = symbols.select("repo_id", "id", "name", "kind", F.concat_ws(" ", words).alias("words"))
    own = s.where(F.col("kind").isin("function", "method") & F.col("name").isNotNull()).groupBy("repo_id", "name").agg(F.min("id").alias("qid"), F.count("*").alias("c"), F.min("words").alias("words")).where("c = 1")
    like = s.where("words <> ''").select("repo_id", "words", "id")
    at = own.join(like, ["repo_id", "words"], "left").groupBy("repo_id", "qid").agg(F.count_if(F.col("id") <= F.col("qid")).alias("rank"))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 6)
    return at.groupBy("repo_id").agg(F.count("*").alias("n_queries"), hit(1).alias("hit_1"), hit(10).alias("hit_10"), F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


def set_accuracy(truth: DataFrame, got: DataFrame, by: str) -> DataFrame:
    """truth(by, item), got(by, item) -> precision, recall and F1 per group; 0 where undefined."""
    t = truth.select(by, "item").distinct().withColumn("t", F.lit(1))
    g = got.select(by, "item").distinct().withColumn("g", F.lit(1))
    c = t.join(g, [by, "item"], "full").groupBy(by).agg(F.count_if(F.col("t").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("t").alias("n_t"), F.count("g").alias("n_g"))
    p, r = F.when(F.col("n_g") > 0, F.col("tp") / F.col("n_g")).otherwise(0.0), F.when(F.col("n_t") > 0, F.col("tp") / F.col("n_t")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_t") + F.col("n_g"))).otherwise(0.0)
    return c.select(by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


PARTS = 1024


def index_percentile(d: DataFrame, by: list[str], value: str, ps: list[int]) -> DataFrame:
    """Sorted value at index floor(p/100*(n-1)) per group, exact, for numeric values.

    Value counts are added up in ``PARTS`` equal parts of a group's span first; only those of the part that holds the
    wanted rank are then looked at one by one, so no task sees all values of a group.
    """
    from functools import reduce

    from pyspark.sql import Window

    c = d.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    span = c.groupBy(*by).agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / PARTS).alias("step"))
    same = lambda a: reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), by, F.lit(True)) & a
    apart = lambda d_: d_.withColumnsRenamed({k: f"_{k}" for k in by})
    c = c.join(apart(span), same(F.lit(True)))
    c = c.select(*by, "v", "n", F.when(F.col("step") > 0, F.floor((F.col("v") - F.col("lo")) / F.col("step"))).otherwise(0).alias("part"))
    parts = c.groupBy(*by, "part").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    parts = parts.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("part")))
    parts = parts.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps]))).withColumn("at", F.expr("(total - 1) * p div 100"))
    held = parts.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(*by, "part", "p", (F.col("at") - F.col("upto") + F.col("n")).alias("at"))
    v = c.join(apart(held).withColumnRenamed("part", "_part"), same(F.col("part") == F.col("_part")))
    v = v.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "p").orderBy("v")))
    return v.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(*by, "p", F.col("v").alias("value"))
