"""Components of similar sets, against those of all pairs."""

import random

import pytest

from plangauge.core.components import components
from plangauge.operators import graph as G


def _cells(spark, sets):
    return spark.createDataFrame([(f, c % 7, c) for f, s in sets.items() for c in s], "floor_id long, cx long, cy long")


def _labels(df):
    return {r.node: r.label for r in df.collect() if r.node != r.label}


@pytest.mark.parametrize("direct", [0, 20])
def test_components_are_those_of_all_pairs(spark, monkeypatch, direct):
    monkeypatch.setattr(G, "DIRECT", direct)
    r = random.Random(5)
    sets = {f: set(r.sample(range(30), r.randint(3, 12))) for f in range(60)} | {100 + f: set(r.sample(range(40, 80), 20)) for f in range(20)}
    cells = _cells(spark, sets)
    own, members = G.classes(cells)
    assert own.count() <= members.count() == len(sets)
    links = None
    for t in (0.5, 0.4):
        labels, links = G.similar_components(own, t, links)
        pairs = G.similar_sets(cells, t)[0]
        assert _labels(labels) == _labels(components(pairs, "a", "b")) != {}


def test_sets_that_are_all_alike_are_not_compared_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "DIRECT", 1)
    r = random.Random(6)
    sets = {f: set(r.sample(range(40), 30)) for f in range(150)}
    own, _ = G.classes(_cells(spark, sets))
    seen = []
    confirm = G._confirmed
    monkeypatch.setattr(G, "_confirmed", lambda met, own, t: seen.append(met.count()) or confirm(met, own, t))
    labels, _ = G.similar_components(own, 0.4)
    assert {x.label for x in labels.collect()} == {0} and sum(seen) < 150 * 149 / 2 / 4


def test_sets_are_confirmed_as_tiles(spark):
    """Cells in all quadrants, in tiles that only one set has and in tiles that both have; no array of cells travels with a pair."""
    sets = {1: [(-9, -1), (-1, -9), (0, 0), (7, 7), (8, 8)], 2: [(-9, -1), (-1, -9), (0, 0), (7, 6), (800000, -800000)], 3: [(-1, -1), (1, 1)]}
    cells = spark.createDataFrame([(f, x, y) for f, c in sets.items() for x, y in c], "floor_id long, cx long, cy long")
    packed = G._packed(G.classes(cells)[0])
    assert {r.f: sum(bin(v & (1 << 64) - 1).count("1") for v in r.tiles.values()) for r in packed.collect()} == {1: 5, 2: 5, 3: 2}
    met = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in G._confirmed(met, packed, 0.3).collect()] == [(1, 2, 3, 3 / 7)]
