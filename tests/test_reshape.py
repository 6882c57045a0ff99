"""Distances of rooms, welded stubs, repeated vertices, source pixels and own rates on small plans."""

import math
import random

import pytest
from helpers import box, edges
from pyspark.sql import functions as F

from plangauge.core import dimensions as D
from plangauge.core.constants import STEP_M
from plangauge.operators import ladder as L
from plangauge.operators import measures as M
from plangauge.operators import outcomes as O
from plangauge.operators import reshape as R


def _inside(p, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def _gap(one, two):
    """The distance of two polygons by walking both outlines closely: no more than a step's error."""
    walk = lambda r: [(a[0] + (b[0] - a[0]) * k / 40, a[1] + (b[1] - a[1]) * k / 40) for a, b in zip(r, r[1:] + r[:1]) for k in range(40)]
    if any(_inside(p, two) for p in walk(one)) or any(_inside(p, one) for p in walk(two)):
        return 0.0
    return min(math.dist(p, q) for p in walk(one) for q in walk(two))


def test_room_distances(spark):
    rnd = random.Random(5)
    star = lambda cx, cy: [(cx + rnd.uniform(0.5, 3) * math.cos(t * math.pi / 4), cy + rnd.uniform(0.5, 3) * math.sin(t * math.pi / 4)) for t in range(8)]
    snap = lambda ring: [(round(x / STEP_M) * STEP_M, round(y / STEP_M) * STEP_M) for x, y in ring]
    pairs = [(snap(star(0, 0)), snap(star(rnd.uniform(0, 8), rnd.uniform(0, 8)))) for _ in range(25)]
    ell = [(0, 0), (9, 0), (9, 9), (7, 9), (7, 2), (0, 2)]
    pairs += [(snap(ell), snap(box(1, 4, 5, 8))), (snap(box(0, 0, 9, 9)), snap(box(4, 4, 5, 5))), (snap(box(4, 4, 5, 5)), snap(box(0, 0, 9, 9))), (snap(box(0, 0, 3, 3)), snap(box(3, 3, 5, 5)))]
    e = edges(spark, [(p, r, "bedroom", ring) for p, both in enumerate(pairs) for r, ring in enumerate(both)])
    links = spark.createDataFrame([(p, 0, 1) for p in range(len(pairs))] * 2 + [(0, 0, 7)], "plan_id long, a int, b int")
    got = {r.plan_id: r.gap_m for r in R.room_distances(e, links).collect()}
    assert sorted(got) == list(range(len(pairs)))
    for p, (one, two) in enumerate(pairs):
        assert got[p] == pytest.approx(_gap(one, two), abs=0.04)
    assert [got[25 + k] for k in range(4)] == [pytest.approx(2.0, abs=0.05), 0.0, 0.0, 0.0]


def test_welding_takes_rounds(spark):
    rings = [(0, r, "bedroom", k, x, y) for r in range(3) for k, (x, y) in enumerate([(0, 0), (1, 0), (2, 0), (30 + 7 * r, 20), (-5, 20 + r)])]
    two = [(1, r, "bedroom", k, x, y) for r in range(2) for k, (x, y) in enumerate([(0, 0), (1, 0), (30, 20 + r)])]
    v = spark.createDataFrame(rings + two, "plan_id long, room_ix int, category string, vix int, ix long, iy long")
    got = {}
    for r in R.welded(v).orderBy("plan_id", "room_ix", "vix").collect():
        got.setdefault((r.plan_id, r.room_ix), []).append((r.ix, r.iy))
    # (0, 0) and (1, 0) meet halfway; (1, 0) is an end of the later edge too, which takes it to 1.5; then both meet at 1
    assert [got[0, r] for r in range(3)] == [[(1.0, 0.0), (30.0 + 7 * r, 20.0), (-5.0, 20.0 + r)] for r in range(3)]
    assert got[1, 0] == [(0.0, 0.0), (1.0, 0.0), (30.0, 20.0)]
    assert R.welded(v.where("plan_id > 5")).count() == 0


def test_repeated_vertices_are_no_crossing(spark):
    rooms = [(1, 0, "bedroom", [(2, 4), (4, 0), (4, 0), (0, 0)]), (1, 1, "bedroom", [(0, 0), (4, 4), (4, 0), (0, 4)]), (1, 2, "bedroom", [(1, 1)] * 3), (1, 3, "bedroom", [(0, 0), (3, 0), (3, 3), (0, 0)])]
    got = {r.room_ix: (r.n, r.crossed) for r in L.room_facts(edges(spark, rooms)).collect()}
    assert got == {0: (3, None), 1: (4, 1), 2: (1, None), 3: (3, None)}
    assert [r.eix for r in M.walls(edges(spark, rooms[:1])).orderBy("eix").collect()] == [0, 1, 2]


def test_source_pixel(spark):
    p = spark.createDataFrame([(1, 0.5, "msd"), (2, None, "msd"), (3, None, "elsewhere"), (4, None, None), (5, 0.1, None), (6, None, "synthetic")], "id int, stated double, source string")
    assert {r.id: r.px for r in p.select("id", D.source_pixel(F.col("stated"), F.col("source")).alias("px")).collect()} == {1: 0.5, 2: 0.38, 3: None, 4: None, 5: 0.1, 6: 0.0}


def test_own_rates_have_a_margin_only_with_both_sides(spark):
    rows = [("x", "rplan", True)] * 3 + [("x", "housegan", False)] * 2 + [("x", "stranger", True)] + [("y", "rplan", True), ("z", "stranger", True)]
    v = spark.createDataFrame([(*r, True, None) for r in rows], "population string, grp string, passed boolean, admitted boolean, not_run string")
    got = O.own_rates(v, D.groups(spark), "population").where("denominator = 'graded'").collect()
    assert sorted((r.population, r.truth or "", r.baseline or "", r.total or 0, round(r.rate)) for r in got) == [("x", "", "housegan", 2, 0), ("x", "rplan", "", 3, 100), ("x", "rplan", "housegan", 0, 100), ("y", "rplan", "", 1, 100)]
