import math

import pytest
from helpers import box, edges

from plangauge.core.constants import STEP_M
from plangauge.operators import coverage as V
from plangauge.operators import measures as M


def units(n, m):
    return box(0, 0, n * 32 * STEP_M, m * 32 * STEP_M)


@pytest.mark.parametrize(("n", "m", "want"), [(1, 1, math.pi / 4), (2, 1, 2 * math.pi / 9), (3, 1, 3 * math.pi / 16)])
def test_compactness_anchors(spark, n, m, want):
    r = M.room_measures(edges(spark, [(1, 0, "bedroom", units(n, m))])).first()
    assert r.pp == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("n", "m", "want"), [(4, 1, 0.25), (1, 4, 0.25), (2, 2, 1.0)])
def test_squareness_anchors(spark, n, m, want):
    assert M.room_measures(edges(spark, [(1, 0, "bedroom", units(n, m))])).first().squareness == want


def test_direction_and_width_of_a_turned_room(spark):
    a = math.radians(30)
    ring = [(1000 * (x * math.cos(a) - y * math.sin(a)), 1000 * (x * math.sin(a) + y * math.cos(a))) for x, y in box(0, 0, 4, 1)]
    e = edges(spark, [(1, 0, "bedroom", ring)])
    d = M.dominant_direction(e)
    assert d.first().angle == pytest.approx(a, abs=1e-4)
    w = M.rotated_boxes(e, d).first()
    assert w.min_width_m == pytest.approx(1000, abs=0.1)
    assert M.rectangularity(e).first().rect == pytest.approx(1, abs=1e-4)


def test_a_clockwise_ring_has_negative_area_and_is_turned(spark):
    e = edges(spark, [(1, 0, "bedroom", units(2, 1)[::-1])])
    assert M.room_measures(e).first().area2 < 0
    v = e.selectExpr("plan_id", "room_ix", "category", "eix AS vix", "ax AS ix", "ay AS iy")
    assert M.room_measures(M.edges_of(M.oriented(v))).first().area2 > 0


def test_bow_tie_crosses_itself(spark):
    e = edges(spark, [(1, 0, "bedroom", [(0, 0), (4, 4), (4, 0), (0, 4)]), (1, 1, "kitchen", box(0, 0, 3, 3))])
    assert [(r.room_ix, r.n) for r in M.crossings(e).collect()] == [(0, 1)]


def test_collinear_vertex_stays_where_another_ring_turns(spark):
    rooms = [(1, 0, "a", [(0, 0), (2, 0), (4, 0), (4, 2), (0, 2)]), (1, 1, "b", box(2, 0, 4, -2)), (2, 0, "a", [(0, 0), (2, 0), (4, 0), (4, 2), (0, 2)])]
    e = edges(spark, rooms).selectExpr("plan_id", "room_ix", "category", "eix AS vix", "ax AS ix", "ay AS iy")
    n = {(r.plan_id, r.room_ix): r["count"] for r in M.without_collinear(e).groupBy("plan_id", "room_ix").count().collect()}
    assert n == {(1, 0): 5, (1, 1): 4, (2, 0): 4}


def test_cover_counts_overlap_once(spark):
    s = 32 * STEP_M
    c = V.cover(edges(spark, [(1, 0, "a", box(0, 0, 2 * s, s)), (1, 1, "b", box(s, 0, 3 * s, s)), (2, 0, "a", box(0, 0, s, s))])).collect()
    got = {r.plan_id: (r.rooms2 / 1024, r.union2 / 1024, r.twice2 / 1024) for r in c}
    assert got == {1: (4.0, 3.0, 1.0), 2: (1.0, 1.0, 0.0)}


def test_crossing_triangles(spark):
    k = 64 * STEP_M
    e = edges(spark, [(1, 0, "a", [(0, 0), (k, 0), (0, k)]), (1, 1, "b", [(k, k), (0, k), (k, 0)]), (2, 0, "a", [(0, 0), (k, 0), (0, k)]), (2, 1, "b", [(0, 0), (k, 0), (k, k)])])
    got = {r.plan_id: (r.union2 / 4096, r.twice2 / 4096) for r in V.cover(e).collect()}
    assert got[1] == pytest.approx((1.0, 0.0)) and got[2] == pytest.approx((0.75, 0.25))


def test_parts_and_shared_walls(spark):
    s = 32 * STEP_M
    e = edges(spark, [(1, 0, "a", box(0, 0, s, s)), (1, 1, "b", box(s, 0, 2 * s, s)), (1, 2, "c", box(4 * s, 0, 5 * s, s))])
    w = V.shared_walls(e).collect()
    assert [(r.a, r.b) for r in w] == [(0, 1)] and w[0].run_m == pytest.approx(s)
    rooms = e.select("plan_id", "room_ix").distinct()
    assert {r.room_ix: r.part for r in V.parts(rooms, e).collect()} == {0: 0, 1: 0, 2: 2}
