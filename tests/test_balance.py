from pyspark.sql import functions as F

from codeloom.operators import balance as B


def test_packing_splits_hot_keys_and_evens_loads():
    heavy, slots = {"hot": 1000, "warm": 120}, [10] * 40
    plan = B.pack(heavy, slots, 8)
    loads = plan.loads(heavy, slots)
    assert max(loads) <= 1.3 * sum(loads) / len(loads)
    assert len(plan.heavy["hot"]) > len(plan.heavy["warm"]) and len(plan.slots) == 40


def test_plan_takes_heavy_keys_out_of_their_slots(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    plan = B.plan_load(d, F.col("k"), 8)
    assert set(plan.heavy) == {"hot"} and plan.total == 3000 and len(plan.heavy["hot"]) >= 8


def test_hot_key_is_spread_over_tasks(spark):
    d = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").cast("string").alias("item"))
    plan = B.plan_load(d, F.col("k"), 6)
    sizes = [r["count"] for r in B.route(d, F.col("k"), F.col("item"), plan).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1.5 * 9000 / 6


def test_counts_with_nulls_repeats_and_foreign_columns(spark, rows):
    data = [("a", "x", "1", 1, "t"), ("a", "y", "2", 1, "t"), ("a", "y", "2", 1, "t"), (None, "y", "3", None, None), ("b", None, "4", 0, ""), ("", "y", "5", 0, ""), ("a", "y", None, 1, "t")]
    d = spark.createDataFrame(data, "repo_id string, dst_id string, id string, bal_task int, tag string").withColumnRenamed("bal_task", "n")
    assert rows(B.distinct_counts(d, ["repo_id", "dst_id"], "id", 4)) == rows(
        spark.createDataFrame([("repo_id", "a", 2), ("repo_id", None, 1), ("repo_id", "b", 1), ("repo_id", "", 1), ("dst_id", "x", 1), ("dst_id", "y", 3), ("dst_id", None, 1)], "f string, k string, n long")
    )
    assert B.distinct_counts(d.where("false"), ["repo_id"], "id", 4).count() == 0
    assert B.heavy_keys(d.where("false"), ["repo_id"], "id").count() == 0


def test_counts_equal_brute_force_under_skew(spark):
    d = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("dst_id"), F.concat(F.lit("e"), F.col("id") % 1500).alias("id"))
    want = {r["dst_id"]: r["n"] for r in d.groupBy("dst_id").agg(F.count_distinct("id").alias("n")).collect()}
    assert {r["key_item"]: r["n"] for r in B.distinct_counts(d, ["dst_id"], "id", 8).collect()} == want


def test_profile_joins_the_replicated_side(spark, rows):
    e = spark.createDataFrame([("e1", "s1", "d1"), ("e2", "s1", "d1"), ("e3", "s2", "d1"), ("e3", "s2", "d1"), ("e4", "s2", "d2"), ("e5", "s2", None), (None, "s2", "d2")], "id string, src_id string, dst_id string")
    n = spark.createDataFrame([("d1", "one"), ("d1", "uno"), ("d3", "x"), (None, "y")], "id string, name string")
    assert rows(B.profile(e, n, tasks=3)) == [("d1", 3, 2, "one"), ("d2", 1, 1, None)]
