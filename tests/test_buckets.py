"""Queries whose tables are staged in buckets of plan_id: what comes after that shuffles nothing, but for what the union of d25 holds: the few rooms with holes."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name, most", [("d24_fill_nearest", 0), ("d25_cell_rooms", 2), ("d26_square_up", 0), ("d31_welded", 0), ("d02_ring_validity", 0), ("i03_worst_room", 0)])
def test_no_shuffle_behind_the_staged_tables(spark, name, most):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_sweep_reads_its_features_from_a_staged_table(spark):
    """Every split reads the features of all plans; the rooms they come from are read once, before."""
    plan = entry.queries()["i15_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
