"""Change history: churn, hotspots and co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths


def churn(commits: DataFrame) -> DataFrame:
    """commits(commit_id, file), one row a touched file -> (file, n_commits)."""
    return commits.where("file IS NOT NULL").select("commit_id", "file").distinct().groupBy("file").agg(F.count("*").alias("n_commits"))


def hotspots(churned: DataFrame, centrality: DataFrame, k: int = 20) -> DataFrame:
    """churned(file, n_commits), centrality(file, degree) -> (file, score, rank): product of both, log-scaled to 0..1."""
    c = churned.agg(F.log(1.0 + F.max("n_commits"))).scalar()
    m = centrality.agg(F.log(1.0 + F.max("degree"))).scalar()
    d = churned.join(centrality, "file")
    score = F.log(1.0 + F.col("n_commits")) / c * F.log(1.0 + F.col("degree")) / m
    d = d.select("file", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "file").limit(k)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file")))


def without_noise(d: DataFrame, path) -> DataFrame:
    """Rows whose path can be a hot path: no dependencies, scripts, tests, generated or secondary trees."""
    return d.where(~paths.path_flag("hotspot_noise", path) & ~paths.path_flag("test", path) & ~paths.path_flag("secondary", path) & ~paths.path_flag("addon", path))


def centrality_only(centrality: DataFrame, k: int = 20) -> DataFrame:
    """Where there is no history: degree over the greatest degree."""
    m = centrality.agg(F.max("degree")).scalar()
    return centrality.select("file", F.round(F.col("degree") / m, 6).alias("score")).orderBy(F.desc("score"), "file").limit(k)


def cochange(commits: DataFrame, max_files: int | None = 30, min_support: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """(file, other, support, confidence) of files changed together in enough commits; commits of more than ``max_files``
    files say nothing and are left out, which also bounds the pairs of a commit. With None every commit counts: pairs are
    then formed of files with ``min_support`` commits only, as no other file can be in a pair that has so many."""
    c = commits.where("file IS NOT NULL").select("commit_id", "file").distinct()
    if max_files is not None:
        size = c.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_files)
        c = c.join(size.select("commit_id"), "commit_id", "left_semi")
    total = c.groupBy("file").agg(F.count("*").alias("n_file"))
    if max_files is None:
        c = c.join(total.where(F.col("n_file") >= min_support).select("file"), "file", "left_semi")
    pairs = c.join(c.withColumnRenamed("file", "other"), "commit_id").where("file <> other").groupBy("file", "other").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    r = pairs.join(total, "file").withColumn("confidence", F.round(F.col("support") / F.col("n_file"), 6))
    return r.where(F.col("confidence") >= min_confidence).select("file", "other", "support", "confidence")


def cochanged_with(rules: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """rules as of ``cochange``, files(file) -> the strongest rules of each of these files, with their place."""
    d = rules.join(files.select("file").distinct(), "file", "left_semi")
    w = Window.partitionBy("file").orderBy(F.desc("confidence"), F.desc("support"), "other")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
