"""Plan-shape guards: no cross products anywhere; top-k stays partial before the shuffle."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_products(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name,operator", [
    ("knn_batch", "WindowGroupLimit"),
    ("stratified_sample", "WindowGroupLimit"),
    ("knn_filtered", "TakeOrderedAndProject"),
    ("category_top10", "TakeOrderedAndProject"),
    ("knn_batch", "FlatMapCoGroupsInPandas"),
])
def test_intended_operators(spark, name, operator):
    assert operator in _plan(entry.queries()[name](spark, SF))


def test_scan_pruning(spark):
    plan = _plan(entry.queries()["knn_filtered"](spark, SF))
    assert "PushedFilters: [IsNotNull(embedding)" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan
