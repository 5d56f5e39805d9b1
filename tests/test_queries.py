"""Every registered query against its SQL counterpart on another engine."""

import pytest
from compare import difference, engine
from conftest import SMALL

from leakscope.plans.registry import registered

REGISTERED = registered()


@pytest.fixture(scope="module")
def other():
    return engine(SMALL)


def test_every_query_has_a_counterpart():
    assert [name for name, (_, sql) in REGISTERED.items() if not sql] == []


# What no plan may contain: rows in Python, and joins that pair everything with everything.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
            "MapInPandas", "FlatMapGroups"]


@pytest.mark.parametrize("name", list(REGISTERED))
def test_equal_to_sql(spark, other, name):
    run, sql = REGISTERED[name]
    df = run(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [word for word in UNWANTED if word in plan] == []
    assert difference(df, other, sql) is None


def test_entry(spark):
    import __spark_entry__ as app

    df = app.entry(spark)
    assert df.count() > 0 and "strategy_id" in df.columns
    assert set(REGISTERED) <= set(app.queries()) and set(REGISTERED) <= set(app.oracle_sql())
