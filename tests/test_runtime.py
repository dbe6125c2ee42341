from types import SimpleNamespace

import pytest

from codeloom import runtime


def test_unset_folder_is_a_temporary_one_and_stays_the_same():
    s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(applicationId="app-test", master="local[4]"))
    a = runtime.shared_folder(s)
    assert a.startswith("file:///") and runtime.shared_folder(s) == a


def test_set_folder_is_used():
    s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://x/y/"))
    assert runtime.shared_folder(s) == "hdfs://x/y"


def test_tables_come_and_go(spark):
    area = runtime.work_area(spark, "t")
    d = area.put(spark.range(10).selectExpr("id", "cast(id % 3 as int) AS k"), "a", ["k"])
    assert d.count() == 10 and area.parts("a") == ["0", "1", "2"] and area.bytes("a") > 0
    assert area.put(spark.range(0).selectExpr("id", "1 AS k"), "empty", ["k"]).count() == 0
    assert area.read(["a/k=1", "a/k=9"], "id long").count() == 3 and area.read(["none"], "id long").count() == 0
    area.drop("a")
    assert area.bytes("a") == 0


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(applicationId="app-c", master=master))
        with pytest.raises(RuntimeError):
            runtime.shared_folder(s)


def test_small_files_appear_whole_and_once(spark):
    at = runtime.work_area(spark, "t").root
    runtime.write_new_text(spark, f"{at}/a.json", "{}")
    assert runtime.read_text(spark, f"{at}/a.json") == "{}" and runtime.names_in(spark, at) == ["a.json"]
    with pytest.raises(FileExistsError):
        runtime.write_new_text(spark, f"{at}/a.json", "x")
    assert runtime.read_text(spark, f"{at}/a.json") == "{}"
