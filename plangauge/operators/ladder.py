"""The ladder of checks: six rungs in order, stopping at the first rejection or the first check that could not run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core import dimensions as D
from plangauge.operators import measures as M

PASSED, REJECTED, NOT_RUN, NOT_TRANSFERABLE, SUPPRESSED, NOT_REACHED = "passed", "rejected", "not run", "not transferable", "suppressed", "not reached"


def known_rungs(names: Iterable[str]) -> tuple[str, ...]:
    """The names, checked: an unknown one is an error before any row is read."""
    names = tuple(names)
    if bad := [n for n in names if n not in K.RUNGS]:
        raise ValueError(f"unknown checks {bad}; the ladder has {K.RUNGS}")
    return names


def off_axis_segments(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, eix, off_m): segments off both axes by more than the tolerance, and by how much."""
    dx, dy = F.abs(F.col("bx") - F.col("ax")) * K.STEP_M, F.abs(F.col("by_") - F.col("ay")) * K.STEP_M
    return edges.where((dx > K.ABS_TOL_M) & (dy > K.ABS_TOL_M)).select(*M.ROOM, "eix", F.least(dx, dy).alias("off_m"))


def room_facts(edges: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """room_measures plus the first off-axis segment and the number of self-crossings of each room; vertices that repeat the one before do not count."""
    edges = M.walls(edges)
    off = off_axis_segments(edges).groupBy(*M.ROOM).agg(F.min_by("off_m", "eix").alias("off_m"))
    rooms = M.room_measures(edges).join(off, M.ROOM, "left")
    crossings = M.crossings(edges) if crossings is None else crossings
    return rooms.join(crossings.select(*M.ROOM, F.col("n").alias("crossed")), M.ROOM, "left")


def rung_inputs(plans: DataFrame, rooms: DataFrame, floors: DataFrame) -> DataFrame:
    """A row per plan with what each rung reads: the first bad ring, the worst room of rungs 2 and 3, the first off-axis room.

    Scores are compared at nine decimals and ties go to the lower room, so that summation order cannot choose the worst room.
    floors (kind, compactness, tag, prop_req) is a small dimension.
    """
    by_tag = floors.select("kind", "tag", "prop_req").where("prop_req > 0")
    r = plans.select("plan_id", "grp", "kind").join(rooms, "plan_id").join(F.broadcast(by_tag), ["kind", "tag"], "left")
    hall, room = F.col("tag") == "Hallway", F.col("room_ix")
    reason = F.when(F.col("n") < 3, "is not a ring").when(F.col("area2") == 0, "has no area").when(F.col("crossed") > 0, "has a self-intersecting outline")
    floor = F.when(F.col("tag").isin(*K.BEDROOMS), F.least("prop_req", F.lit(K.BEDROOM_CAP))).otherwise(F.col("prop_req"))
    margin = F.round(F.col("squareness") - floor, 9)
    out = r.groupBy("plan_id", "grp", "kind").agg(
        F.count(F.lit(1)).alias("rooms"),
        F.min(F.when(reason.isNotNull(), F.struct(room.alias("room_ix"), reason.alias("reason")))).alias("outline"),
        F.min(F.when(~hall, F.struct(F.round("pp", 9).alias("score"), room.alias("room_ix"), F.col("category")))).alias("compact"),
        F.min(F.when(floor.isNotNull(), F.struct(margin.alias("margin"), room.alias("room_ix"), F.col("category"), F.col("squareness"), floor.alias("floor")))).alias("proportion"),
        F.min(F.when(~hall & F.col("off_m").isNotNull(), F.struct(room.alias("room_ix"), F.col("category"), F.col("off_m")))).alias("appendix"),
    )
    limits = floors.select("kind", "compactness").distinct()
    return out.join(F.broadcast(limits), "kind", "left")


def grade(inputs: DataFrame, suppress: Iterable[str] = (), admitted: DataFrame | None = None) -> DataFrame:
    """inputs plus rungs (array of number, name, verdict, reason in order), stopped_at, not_run, passed (null: no verdict).

    A suppressed check is evaluated; its rejection is recorded as suppressed and the plan goes on. Plans that are not in
    `admitted` (plan_id) were refused at ingest and reach no rung.
    """
    off = set(known_rungs(suppress))
    if admitted is not None:
        inputs = inputs.join(admitted.select("plan_id", F.lit(True).alias("admitted")), "plan_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    elif "admitted" not in inputs.columns:
        inputs = inputs.withColumn("admitted", F.lit(True))

    def verdict(name: str, bad: Column) -> Column:
        return F.when(bad, F.lit(SUPPRESSED if name in off else REJECTED)).otherwise(PASSED)

    v = [
        verdict(K.RUNGS[0], F.col("outline").isNotNull()),
        verdict(K.RUNGS[1], F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False))),
        verdict(K.RUNGS[2], F.coalesce(F.col("proportion.margin") < -K.ABS_TOL_M, F.lit(False))),
        F.when(F.col("appendix").isNotNull(), NOT_RUN).otherwise(NOT_TRANSFERABLE),
        F.lit(NOT_TRANSFERABLE),
        F.lit(NOT_TRANSFERABLE),
    ]
    why = [
        F.format_string("room %d %s", F.col("outline.room_ix"), F.col("outline.reason")),
        F.format_string("room %d (%s) scores %.4f against a floor of %.4f", F.col("compact.room_ix"), F.col("compact.category"), F.col("compact.score"), F.col("compactness")),
        F.format_string("room %d (%s) has squareness %.4f against a floor of %.4f", F.col("proportion.room_ix"), F.col("proportion.category"), F.col("proportion.squareness"), F.col("proportion.floor")),
        F.format_string("room %d (%s) has a segment %.4f m off both axes", F.col("appendix.room_ix"), F.col("appendix.category"), F.col("appendix.off_m")),
    ]
    g = inputs.select("*", *[x.alias(f"v{i}") for i, x in enumerate(v)])
    stops = F.coalesce(*[F.when(F.col(f"v{i}").isin(REJECTED, NOT_RUN), i) for i in range(4)], F.lit(9))
    g = g.withColumn("stop", F.when(F.col("admitted"), stops).otherwise(-1))
    rung = lambda i: F.struct(F.lit(i + 1).alias("number"), F.lit(K.RUNGS[i]).alias("name"), F.when(F.col("stop") < i, NOT_REACHED).otherwise(F.col(f"v{i}")).alias("verdict"), F.when((F.col("stop") >= i) & F.col(f"v{i}").isin(REJECTED, NOT_RUN, SUPPRESSED), why[i] if i < 4 else F.lit("")).otherwise("").alias("reason"))
    names = F.array(*[F.lit(n) for n in K.RUNGS])
    at = F.when(F.col("stop").between(0, 5), names[F.greatest("stop", F.lit(0))])
    not_run = F.col("stop") == 3
    return g.select(
        *inputs.columns, F.array(*[rung(i) for i in range(6)]).alias("rungs"),
        F.when(~not_run, at).alias("stopped_at"), F.when(not_run, at).alias("not_run"),
        F.when(~F.col("admitted"), False).when(not_run, F.lit(None)).otherwise(F.col("stop") == 9).alias("passed"),
    )


def verdict_text(graded: DataFrame) -> DataFrame:
    """plan_id and the one-line verdict."""
    text = (
        F.when(~F.col("admitted"), "no verdict: refused at ingest").when(F.col("not_run").isNotNull(), F.concat(F.lit("no verdict: "), F.col("not_run"), F.lit(" not run")))
        .when(F.col("stopped_at").isNotNull(), F.concat(F.lit("stopped at "), F.col("stopped_at"))).otherwise("passed")
    )
    return graded.select("plan_id", "grp", text.alias("verdict"))


def stop_class(graded: DataFrame) -> DataFrame:
    """graded plus `class`: refused, the rung it stopped at, the check that did not run, or passed."""
    return graded.withColumn("class", F.when(~F.col("admitted"), "refused").when(F.col("not_run").isNotNull(), F.concat(F.col("not_run"), F.lit(" not run"))).when(F.col("stopped_at").isNotNull(), F.col("stopped_at")).otherwise("passed"))


def reports(graded: DataFrame) -> DataFrame:
    """(plan_id, report): each plan's report as JSON, scores at nine decimals."""
    body = F.struct("plan_id", "grp", "kind", "rooms", "admitted", "passed", "stopped_at", "not_run", F.round("compact.score", 9).alias("worstCompactness"), "rungs")
    return graded.select("plan_id", F.to_json(body).alias("report"))


def width_observations(boxes: DataFrame, standards: DataFrame) -> DataFrame:
    """(plan_id, room_ix, tag, min_width_m, required, met): observations beside the ladder, for tags with a required width."""
    need = standards.where("min_width > 0").select("tag", F.col("min_width").alias("required"))
    rooms = boxes.withColumn("tag", D.tag_of(F.col("category"))).join(F.broadcast(need), "tag")
    return rooms.select(*M.ROOM, "tag", "min_width_m", "required", (F.col("min_width_m") >= F.col("required") - K.ABS_TOL_M).alias("met"))
