"""Ordered rings against flood filling, and entries on them."""

import random
from collections import defaultdict

import pytest

from plangauge.operators import coverage as V
from plangauge.operators import rings as R

EDGES = "plan_id long, room_ix int, eix int, ax long, ay long, bx long, by_ long"


def edges_of(spark, plans):
    """plans: {plan_id: [ring of points, ...]}, a ring for each room."""
    rows = [(p, r, i, *ring[i], *ring[(i + 1) % len(ring)]) for p, rooms in plans.items() for r, ring in enumerate(rooms) for i in range(len(ring))]
    return spark.createDataFrame(rows, EDGES)


def box(x, y, w=10, h=10):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def rings_of(spark, plans):
    found = defaultdict(dict)
    for r in R.outlines(edges_of(spark, plans)).orderBy("plan_id", "ring", "seq").collect():
        found[r.plan_id].setdefault(r.ring, (round(r.area2, 6), []))[1].append((r.x, r.y))
    return {p: list(v.values()) for p, v in found.items()}


def test_rings_by_hand(spark):
    plans = {
        1: [box(0, 0), box(10, 0)],  # a shared wall goes, and with it its ends
        2: [box(0, 0, 30, 10), box(0, 20, 30, 10), box(0, 10), box(20, 10)],  # a court
        3: [box(0, 0), box(10, 10)],  # a corner in common
        4: [[(0, 0), (40, 0), (20, 30)], [(0, 20), (20, -10), (40, 20)]],  # outlines that cross
        5: [box(0, 0, 30, 30), box(10, 10)],  # one inside the other
        6: [[(0, 0), (0, 10), (10, 10), (10, 0)]],  # clockwise
    }
    got = rings_of(spark, plans)
    assert got[1] == [(200, [(0, 0), (20, 0), (20, 10), (0, 10)])]
    assert got[2] == [(900, [(0, 0), (30, 0), (30, 30), (0, 30)]), (-100, [(10, 10), (10, 20), (20, 20), (20, 10)])]
    assert got[3] == [(100, box(0, 0)), (100, box(10, 10))] and got[5] == [(900, box(0, 0, 30, 30))] and got[6] == [(100, box(0, 0))]
    cover = V.cover(edges_of(spark, {4: plans[4]})).first()
    assert len(got[4]) == 1 and len(got[4][0][1]) == 12 and got[4][0][0] == pytest.approx(cover.union2, abs=1e-4)


def flood(cells, diagonal):
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, n = set(cells), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
    return n


def test_rings_of_cells_against_flood_filling(spark):
    """Floors made of squares: one outer ring for each piece joined along sides, one inner ring for each enclosed piece joined at sides or corners."""
    rnd = random.Random(5)
    floors = {p: sorted({(x, y) for x in range(7) for y in range(7) if rnd.random() < rnd.choice((0.45, 0.6, 0.75))} or {(0, 0)}) for p in range(40)}
    got = rings_of(spark, {p: [box(10 * x, 10 * y) for x, y in cells] for p, cells in floors.items()})
    for p, cells in floors.items():
        sides = sum((x + dx, y + dy) not in set(cells) for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        around = {(x, y) for x in range(-1, 8) for y in range(-1, 8)} - set(cells)
        length = lambda pts: sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True))
        assert sum(a for a, _ in got[p]) == 100 * len(cells) and sum(length(pts) for _, pts in got[p]) == 10 * sides
        assert sum(a > 0 for a, _ in got[p]) == flood(cells, False) and sum(a < 0 for a, _ in got[p]) == flood(around, True) - 1
        assert all(pts[0] == min(pts) for _, pts in got[p])


def test_entry_on_the_outline_and_not_on_inner_walls(spark):
    plans = {1: [box(0, 0, 40, 10), box(0, 10, 40, 30)], 2: [box(0, 0, 40, 10), box(0, 10, 40, 30)], 3: [box(0, 0), box(50, 0, 20, 30)], 4: [box(0, 0)]}
    points = spark.createDataFrame([(1, 20.0, 11.0), (3, 0.0, -3.0), (4, None, 1.0)], "plan_id long, px double, py double")
    got = {r.plan_id: r for r in R.entry_on_outline(R.outlines(edges_of(spark, plans)), points).collect()}
    step = R.STEP_M
    # the wall between the rooms of plan 1 is one step away, the outline eleven
    assert (got[1].x_m, got[1].y_m, got[1].offset_m, got[1].edge, got[1].station, got[1].synthetic) == pytest.approx((20 * step, 0, 11 * step, 0, 0.5, False))
    assert (got[2].edge, got[2].station, got[2].offset_m, got[2].synthetic) == (0, 0.5, 0, True)
    assert (got[3].x_m, got[3].y_m) == pytest.approx((50 * step, 0)), "the larger part is the outline"
    assert got[4].synthetic and got[4].offset_m == 0
    assert R.entry_on_outline(R.outlines(spark.createDataFrame([], EDGES)), points).count() == 0
