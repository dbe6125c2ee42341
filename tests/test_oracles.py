import os

import pytest

import __spark_entry__ as entry
from codeloom.plans import registry
from tests.oracle import both

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = both(spark, DATA, name, entry)
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
