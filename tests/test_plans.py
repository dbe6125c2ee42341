import os
import re

import pytest

from codeloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "unread"), [("callers", {"confidence", "signature", "line_start"}), ("in_degrees", {"confidence", "src_id", "repo_id"}), ("usage_tools", {"args_json", "why", "result_summary"}), ("p5_dst_profile", {"confidence", "kind", "indexed_at"})])
def test_scans_read_no_other_columns(spark, name, unread):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^\n]*)", plan(spark, name)))))
    assert read and not read & unread


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"p3_found", "p3_hierarchy"}))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name)
