"""Every registered query against its SQL equivalent on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tests.verify import compare, connect
from visitorlens.plans.oracle import ORACLE
from visitorlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "keyword"
    assert df.count() > 0


def test_no_query_runs_python_per_row_or_pairs_everything(spark):
    arrow = {"seed_similarity", "topic_items", "topic_top_items", "phrase_topic_hashed", "phrase_topic_letters"}
    for name, fn in QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        if name not in arrow:
            assert "Python" not in plan and "Arrow" not in plan, name
