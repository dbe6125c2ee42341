import os

import pytest

import __spark_entry__ as entry
from codeloom.llm import queries
from tests.oracle import both

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = both(spark, DATA, name, entry)
    assert mine == theirs


@needs_data
@pytest.mark.parametrize(("name", "columns"), [("p2_found", ["repo_id", "file_id"]), ("p7_windows", ["doc_id", "piece", "token_start", "n_tokens", "window_id"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id", "subject"])])
def test_query_runs(spark, name, columns):
    d = queries.QUERIES[name](spark, DATA)
    assert d.columns == columns and d.count() > 0


@needs_data
def test_subjects_agree_with_held_out_labels(spark):
    """A fifth of the labelled documents neither trains nor calibrates; labels have wrong rows themselves."""
    r = queries.QUERIES["p9_held_out"](spark, DATA.replace("0.001", "0.01")).first()
    assert r["n_labelled"] > 30 and r["precision"] > 0.75 and r["recall"] > 0.75
