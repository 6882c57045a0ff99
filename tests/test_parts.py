"""Derived tables in parts by plan: joins on plan and room read staged edges without a shuffle, and results do not depend on the parts."""

import pyspark.sql.functions as F

from plangauge.operators import coverage as V
from plangauge.operators import measures as M
from plangauge.operators import rings as R
from plangauge.plans import catalog, reshaping
from plangauge.sources import bridge

SF = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_staged_edges_join_by_room_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(bridge, "MOST", 1_000)
    edges, n = bridge.staged_edges(spark, SF)
    assert n >= 6
    assert _exchanges(edges.join(M.centroids(edges), M.ROOM)) == 0
    assert _exchanges(V.slabs_of(edges)) == 0
    assert _exchanges(V.spans(edges)) == 0
    assert _exchanges(V.cover(edges)) == 0


def test_rings_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    few = R.outlines(*bridge.staged_edges(spark, SF)).collect()
    monkeypatch.setattr(bridge, "MOST", 1_000)
    many = R.outlines(*bridge.staged_edges(spark, SF)).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and few


def test_only_proper_crossings_between_rooms_count(spark):
    square = lambda room, x, y: [(1, room, "kitchen", k, *p) for k, p in enumerate(((x, y, x + 4, y), (x + 4, y, x + 4, y + 4), (x + 4, y + 4, x, y + 4), (x, y + 4, x, y)))]
    rows = square(0, 0, 0) + square(1, 4, 0) + square(2, 2, 2) + square(3, 20, 0)
    edges = spark.createDataFrame(rows, "plan_id long, room_ix int, category string, eix int, ax long, ay long, bx long, by_ long")
    assert sorted(r.x for r in V.crossing_points(edges).select(F.col("x")).collect()) == [2.0, 4.0, 4.0, 6.0]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_links_sort_no_edges(spark):
    plan = _plan(reshaping.d27_wide_links(spark, SF))
    assert "lineitem" not in plan and plan.count("Sort [") <= 8


def test_swallowed_pairs_derive_nothing_twice(spark):
    assert "lineitem" not in _plan(reshaping.d15_swallowed_pairs(spark, SF))


def test_entry_rooms_derive_nothing_twice(spark):
    assert "lineitem" not in _plan(catalog.f04_entry_rooms(spark, SF))
