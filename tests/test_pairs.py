"""All pairs of floors that share a cell, by classes of equal floors and blocks of classes, against pairs made one by one."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from plangauge.operators import graph as G


def _floors(spark):
    r = random.Random(7)
    some = [{(r.randint(-9, 9), r.randint(-9, 9)) for _ in range(r.randint(1, 25))} for _ in range(30)]
    sets = {i: s for i, s in enumerate([*some, *some[:12], *some[:5], {(None, 3), (None, 4), (2, None), (1, 1)}, {(None, 3), (None, 4), (2, None), (1, 1)}, {(None, 3)}, {(None, 3)}])}
    rows = [(f, x, y) for f, s in sets.items() for x, y in s]
    return sets, spark.createDataFrame(rows + rows[:40] + [(None, 1, 1)], "floor_id long, cx long, cy int")


@pytest.mark.parametrize("most, array", [(1024, 256), (8, 1)])
def test_pairs_are_those_made_one_by_one(spark, monkeypatch, most, array):
    monkeypatch.setattr(G, "MOST", most)
    monkeypatch.setattr(G, "ARRAY", array)
    sets, cells = _floors(spark)
    want = {}
    for a in sets:
        for b in range(a + 1, len(sets)):
            if shared := sum(None not in c for c in sets[a] & sets[b]):
                want[a, b] = (shared, shared / (len(sets[a]) + len(sets[b]) - shared))
    rows = G.jaccard(cells).collect()
    assert len(rows) == len(want) and {(r.a, r.b): (r.shared, r.similarity) for r in rows} == want
    counts, n = G.similarity_counts(cells)
    found = Counter()
    for r in counts.collect():
        found[r.similarity] += r.pairs
    assert found == Counter(s for _, s in want.values()) and n.first().n == len(sets)


@pytest.mark.parametrize("name", ["h02_jaccard", "h07_similarity_histogram"])
def test_pairs_are_not_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not any(f"hashpartitioning({c}#" in plan for c in ("a", "b", "cx", "cy"))


def test_copies_are_compared_once(spark):
    """Sixty copies of forty floors are forty classes: as many pairs meet as without copies."""
    r = random.Random(8)
    some = [(f, x, r.randint(0, 30)) for f in range(40) for x in range(10)]
    schema = "floor_id long, cx long, cy long"
    once, often = (G.met_classes(G.tiled_classes(spark.createDataFrame(rows, schema), "floor_id")[0])[0].count() for rows in (some, [(f + 40 * k, x, y) for f, x, y in some for k in range(60)]))
    assert once == often > 0
