"""Every registered corpus query against its SQL, or for rows where it has none."""

import pytest

from tests.verify import compare, connect
from visitorlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = {"op3_chat_format", "op4_mixing", "op6_shards", "op7_quality_rules"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_plans(spark):
    for name, fn in QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        assert "BatchEvalPython" not in plan, name
        if name in NATIVE:
            assert "Python" not in plan and "Arrow" not in plan, name
