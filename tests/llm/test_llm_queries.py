import pytest

from helpers import SF, duck, same
from glimmer.llm.oracles import ORACLES
from glimmer.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) and same(got, duck(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_native_operators_run_no_python(spark):
    for name in ("op1_source_mixing", "op3_chat_formatting", "op7_quality_rules", "op8_license_scan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))
