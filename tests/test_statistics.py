import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plangauge.core import dimensions as D
from plangauge.core.components import components
from plangauge.operators import calibration as C
from plangauge.operators import graph as G
from plangauge.operators import outcomes as O


def test_wilson_and_newcombe_by_hand(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "passed long, total long")
    r, none = O.with_wilson(df).orderBy(F.desc("total")).collect()
    assert (r.rate, r.low, r.high) == pytest.approx((80, 49.0162, 94.3318), abs=1e-3) and none.rate is None
    d, lo, hi = df.where("total > 0").select(*O.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80))).first()
    assert (d, lo, hi) == pytest.approx((20.0, 5.24, 33.39), abs=0.01)


def test_binomial_draws_have_the_right_law(spark):
    cells = spark.createDataFrame([("a", 30, 100), ("b", 0, 50), ("c", 50, 50)], "grp string, passed long, total long")
    d = O.binomial_draws(cells, 3000).toPandas().groupby("grp").k
    assert d.mean()["a"] == pytest.approx(30, abs=0.5) and d.var()["a"] == pytest.approx(21, rel=0.12)
    assert set(d.mean()[["b", "c"]]) == {0, 50}


def test_cluster_replicates_keep_totals_of_whole_clusters(spark):
    totals = spark.createDataFrame([("a", f"c{i}", i + 1, 1, 1, 1) for i in range(7)], "grp string, cluster string, graded long, passed long, admitted long, verdict long")
    r = O.cluster_replicates(totals, 40).toPandas()
    assert len(r) == 40 and (r.passed == 7).all() and r.graded.between(7, 49).all() and r.graded.nunique() > 5


def test_cluster_replicates_have_the_law_of_single_draws(spark):
    """400 clusters in three classes and 100 of their own: every replicate holds 500 clusters; means and covariances are a multinomial's."""
    values = [(1, 0)] * 250 + [(0, 1)] * 100 + [(1, 1)] * 50 + [(2 + i % 50, i) for i in range(100)]
    rows = [(g, i, 1, x, y) for g in ("a", "b") for i, (x, y) in enumerate(values)]
    r = O.cluster_replicates(spark.createDataFrame(rows, "grp string, cluster long, one long, x long, y long"), 3000).toPandas()
    assert len(r) == 6000 and set(r.replicate) == set(range(3000)) and (r.one == 500).all()
    want_mean, want = 500 * np.mean(values, axis=0), 500 * np.cov(np.array(values).T, bias=True)
    for g in ("a", "b"):
        got = r[r.grp == g][["x", "y"]].to_numpy(float)
        assert got.mean(axis=0) == pytest.approx(want_mean, abs=5 * np.sqrt(want.diagonal().max() / 3000))
        assert np.cov(got.T) == pytest.approx(want, rel=0.12)
    wide = r.pivot(index="replicate", columns="grp", values="x")
    assert abs(np.corrcoef(wide.a, wide.b)[0, 1]) < 0.08


def test_cluster_replicates_of_hard_groups(spark):
    """A group of one cluster, one of equal clusters, an empty table; the order of rows and the names of clusters change nothing."""
    schema = "grp string, cluster string, graded long, passed long"
    rows = [("one", "c", 7, 3), *[("same", f"c{i}", 2, 1) for i in range(1000)], *[("mixed", f"c{i}", 1 + i % 3, i % 2) for i in range(300)]]
    r = O.cluster_replicates(spark.createDataFrame(rows, schema), 30).toPandas()
    assert (r[r.grp == "one"][["graded", "passed"]] == (7, 3)).all(None) and (r[r.grp == "same"][["graded", "passed"]] == (2000, 1000)).all(None)
    again = O.cluster_replicates(spark.createDataFrame([(g, "x" + c, a, b) for g, c, a, b in reversed(rows)], schema), 30).toPandas()
    by = ["grp", "replicate"]
    assert r.sort_values(by).reset_index(drop=True).equals(again.sort_values(by).reset_index(drop=True)[r.columns])
    assert O.cluster_replicates(spark.createDataFrame([], schema), 30).count() == 0


def test_margin_needs_both_sides(spark):
    cells = spark.createDataFrame([("rplan", 5, 10, 10, 10)], "grp string, passed long, graded long, admitted long, verdict long")
    assert O.margins(O.rates(cells), D.groups(spark)).count() == 0


def _bisect(rooms, n_plans, level):
    pools = defaultdict(list)
    for _, t, sq in rooms:
        pools[t].append(sq)
    refused = lambda p: len({k for k, t, sq in rooms if sq < (min(q, 0.6) if t in ("Bedroom", "PrimaryBedroom") else q) - 0.001 for q in [np.quantile(pools[t], p)]}) / n_plans
    fl = lambda p: {t: min(np.quantile(v, p), 0.6) if t == "Bedroom" else np.quantile(v, p) for t, v in pools.items()}
    def refusal(p):
        f = fl(p)
        return len({k for k, t, sq in rooms if sq < f[t] - 0.001}) / n_plans
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if refusal(mid) < level else (lo, mid)
    best = min((lo, hi), key=lambda p: abs(refusal(p) - level))
    return refusal(best), refusal


def test_fit_rung3_refuses_what_bisection_refuses(spark):
    rnd = random.Random(3)
    rooms = [(k, rnd.choice(["Bedroom", "Kitchen", "Bathroom"]), round(rnd.uniform(0.1, 1), 6)) for k in range(300) for _ in range(rnd.randint(1, 6))]
    df = spark.createDataFrame([(k, i, t, sq, "x") for i, (k, t, sq) in enumerate(rooms)], "plan_id long, room_ix int, tag string, sq double, kind string")
    plans = df.select("plan_id", "kind").distinct()
    levels = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.2)], "level double")
    for r in C.fit_rung3(plans, df, levels, "kind").collect():
        want, refusal = _bisect(rooms, 300, r.level)
        assert abs(refusal(r.p) - r.level) <= abs(want - r.level) + 1e-9


def test_fit_rung2_is_the_midpoint_of_order_statistics(spark):
    plans = spark.createDataFrame([("x", i, float(i) / 100) for i in range(100)] + [("x", 200, None)], "kind string, plan_id long, pp double")
    got = {r.level: r.compactness for r in C.fit_rung2(plans, spark.createDataFrame([(0.0,), (0.05,), (1.0,)], "level double"), "kind").collect()}
    assert got[0.05] == pytest.approx(0.045) and got[0.0] == 0.0 and got[1.0] == pytest.approx(0.99)


def _union_find(edges):
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_on_random_graphs_and_long_chains(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {x: r for x, r in _union_find([(a, b) for a, b in links if b is not None and a != b]).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_apartments(spark):
    rooms = spark.createDataFrame([(1, i, c) for i, c in enumerate(["bedroom", "bathroom", "corridor", "livingroom", "bathroom", "storage"])], "plan_id long, room_ix int, category string")
    access = spark.createDataFrame([(1, 0, 0, 1, "door"), (1, 1, 1, 2, "entrance"), (1, 2, 2, 3, "entrance"), (1, 3, 4, 3, "door")], "plan_id long, edge_ix int, a int, b int, kind string")
    m = G.apartments(rooms, G.room_components(rooms, access))
    assert {r.room_ix: r.unit_ix for r in m.collect()} == {0: 0, 1: 0, 2: None, 3: 1, 4: 1, 5: None}
    assert {r.unit_ix: r.entry_room for r in G.entry_rooms(m, access).collect()} == {0: 1, 1: 3}
    assert {(r.unit_ix, r.room_ix): r.code for r in G.exposure_context(m).collect()}[0, 3] == -3


def test_jaccard_against_brute_force(spark):
    rnd = random.Random(2)
    sets = {f: {(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(rnd.randint(1, 12))} for f in range(25)}
    rows = [(f, x, y) for f, s in sets.items() for x, y in s for _ in range(2)]
    got = {(r.a, r.b): r.similarity for r in G.jaccard(spark.createDataFrame(rows, "floor_id long, cx int, cy int")).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_similar_sets_against_all_pairs(spark, threshold):
    """Copies are one class; every pair of different sets at or over the threshold is there, and no other; a cell that all share and negative cells included."""
    rnd = random.Random(11)
    floors: dict[int, set] = {}
    for f in range(120):
        base = set(floors[rnd.randrange(f)]) if f and rnd.random() < 0.7 else {(rnd.randrange(-9, 9), rnd.randrange(-3, 9)) for _ in range(rnd.randint(1, 25))}
        for _ in range(rnd.choice((0, 0, 1, 3, 6))):
            base ^= {(rnd.randrange(-9, 9), rnd.randrange(-3, 9))}
        floors[f] = base | {(0, 0)}
    rows = [(f, x, y) for f, s in floors.items() for x, y in s]
    pairs, members = G.similar_sets(spark.createDataFrame(rows + rows[:30], "floor_id long, cx int, cy int"), threshold)
    rep = {f: min(g for g in floors if floors[g] == s) for f, s in floors.items()}
    assert {r.floor: r.rep for r in members.collect()} == rep and len(set(rep.values())) < 115
    alike = lambda a, b: len(floors[a] & floors[b]) / len(floors[a] | floors[b])
    want = {(a, b): alike(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and alike(a, b) >= threshold}
    assert {(r.a, r.b): r.similarity for r in pairs.collect()} == want and want


def test_similar_sets_of_nothing(spark):
    pairs, members = G.similar_sets(spark.createDataFrame([], "floor_id long, cx int, cy int"), 0.4)
    assert pairs.count() == members.count() == 0
