"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NO_SQL = set(entry.queries()) - set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_only_models_and_extractions_lack_sql():
    assert all(n.startswith(("gbt_", "few_shot_sweep", "extract_", "signals_to_metrics", "op", "pipeline")) for n in NO_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 63 and "rms" in df.columns


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # the fold totals are one aggregated row
    assert "BroadcastNestedLoopJoin" not in plan or name in {"lopo_folds", "seeded_folds"}
