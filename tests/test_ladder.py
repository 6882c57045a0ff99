import pytest
from helpers import box, edges

from plangauge.core import dimensions as D
from plangauge.operators import ladder as L

KINDS = "plan_id long, grp string, kind string"


def graded(spark, rooms, suppress=(), kind="rplan"):
    plans = spark.createDataFrame([(p, "rplan", kind) for p in sorted({r[0] for r in rooms})], KINDS)
    return L.grade(L.rung_inputs(plans, L.room_facts(edges(spark, rooms)), D.floors(spark)), suppress)


def test_clean_plan_passes_and_later_rungs_do_not_transfer(spark):
    r = graded(spark, [(1, 0, "livingroom", box(0, 0, 4, 3)), (1, 1, "bedroom", box(4, 0, 7, 3))]).first()
    assert r.passed is True and [x.verdict for x in r.rungs] == ["passed"] * 3 + ["not transferable"] * 3


def test_narrow_bedroom_stops_and_passes_when_suppressed(spark):
    rooms = [(1, 0, "livingroom", box(0, 0, 4, 4)), (1, 1, "bedroom", box(4, 0, 8, 1.6))]
    r = graded(spark, rooms).first()
    assert (r.stopped_at, r.passed) == ("roomProportions", False) and r.rungs[3].verdict == "not reached"
    r = graded(spark, rooms, ["roomProportions"]).first()
    assert (r.stopped_at, r.passed) == (None, True) and r.rungs[2].verdict == "suppressed"


def test_suppression_shows_the_later_stop(spark):
    rooms = [(1, 0, "bathroom", box(0, 0, 30, 1))]
    assert graded(spark, rooms).first().stopped_at == "roomCompactness"
    assert graded(spark, rooms, ["roomCompactness"]).first().stopped_at == "roomProportions"


def test_skew_wall_means_no_verdict(spark):
    r = graded(spark, [(1, 0, "livingroom", [(0, 0), (4, 0), (4, 4), (1, 4)])]).first()
    assert (r.not_run, r.passed, r.stopped_at) == ("roomAppendices", None, None)
    assert L.verdict_text(graded(spark, [(1, 0, "livingroom", [(0, 0), (4, 0), (4, 4), (1, 4)])])).first().verdict == "no verdict: roomAppendices not run"


def test_hallways_are_skipped_by_compactness_only(spark):
    r = graded(spark, [(1, 0, "corridor", box(0, 0, 40, 1))], kind="msd-unit").first()
    assert r.stopped_at == "roomProportions"
    assert graded(spark, [(1, 0, "corridor", box(0, 0, 40, 1))]).first().passed is True


def test_bad_outline_comes_first(spark):
    r = graded(spark, [(1, 0, "livingroom", box(0, 0, 4, 4)), (1, 1, "bedroom", [(0, 0), (4, 4), (4, 0), (0, 4)])]).first()
    assert r.stopped_at == "roomOutline" and "room 1" in r.rungs[0].reason


def test_unknown_check_is_an_error_before_any_row(spark):
    with pytest.raises(ValueError):
        graded(spark, [(1, 0, "bedroom", box(0, 0, 3, 3))], ["nope"])


def test_refused_plans_reach_no_rung(spark):
    rooms = [(1, 0, "bedroom", box(0, 0, 3, 3)), (2, 0, "bedroom", box(0, 0, 3, 3))]
    plans = spark.createDataFrame([(1, "rplan", "rplan"), (2, "rplan", "rplan")], KINDS)
    g = L.grade(L.rung_inputs(plans, L.room_facts(edges(spark, rooms)), D.floors(spark)), admitted=spark.createDataFrame([(2,)], "plan_id long"))
    assert {r.plan_id: r["class"] for r in L.stop_class(g).collect()} == {1: "refused", 2: "passed"}
