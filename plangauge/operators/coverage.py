"""Set-based geometry between the rooms of a plan: cover depth by slabs, shared and facing walls, parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core.constants import STEP_M
from plangauge.core.staging import stage_by
from plangauge.operators import graph
from plangauge.operators import measures as M


def _counterclockwise(edges: DataFrame) -> DataFrame:
    """Edges with direction `turn`: +1 along counter-clockwise rings, -1 along clockwise ones."""
    area = F.sum(M.cross()).over(Window.partitionBy(*M.ROOM))
    return edges.withColumn("_a", area).withColumn("turn", F.when(F.col("_a") < 0, -1).otherwise(1)).drop("_a")


def near_rooms(edges: DataFrame) -> DataFrame:
    """(plan_id, a, b, x, y): rooms a < b of a plan whose boxes overlap by more than a line, and the sides of what the boxes share. Only such rooms cross or claim the same floor."""
    box = edges.groupBy(*M.ROOM).agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    of = lambda r: box.select("plan_id", F.col("room_ix").alias(r), *[F.col(c).alias(r + c) for c in ("x0", "x1", "y0", "y1")])
    p = of("a").join(of("b").hint("shuffle_hash"), "plan_id").where("a < b AND ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1")
    side = lambda c: F.least(f"a{c}1", f"b{c}1") - F.greatest(f"a{c}0", f"b{c}0")
    return p.select("plan_id", "a", "b", side("x").alias("x"), side("y").alias("y"))


def crossing_points(edges: DataFrame) -> DataFrame:
    """(plan_id, x): where edges of two rooms of a plan cross properly. Only edges of near rooms are compared, and of those only such whose boxes overlap."""
    e = edges.select("plan_id", "room_ix", "ax", "ay", "bx", F.col("by_").alias("by"))
    near = e.join(near_rooms(edges).select("plan_id", F.col("a").alias("room_ix"), F.col("b").alias("room2")).hint("shuffle_hash"), M.ROOM)
    o = e.select("plan_id", F.col("room_ix").alias("room2"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    p = o.join(near.hint("shuffle_hash"), ["plan_id", "room2"]).where("least(ax, bx) < greatest(cx, dx) AND least(cx, dx) < greatest(ax, bx) AND least(ay, by) < greatest(cy, dy) AND least(cy, dy) < greatest(ay, by)")
    p = p.withColumn("d", F.expr("(bx - ax) * (dy - cy) - (by - ay) * (dx - cx)")).withColumn("t", F.expr("(cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)")).withColumn("u", F.expr("(cx - ax) * (by - ay) - (cy - ay) * (bx - ax)"))
    inside = "d <> 0 AND sign(t) = sign(d) AND abs(t) < abs(d) AND sign(u) = sign(d) AND abs(u) < abs(d)"
    return p.where(inside).select("plan_id", F.expr("ax + cast((bx - ax) * t as double) / d").alias("x"))


def cover(edges: DataFrame, *by: str, slabs: DataFrame | None = None) -> DataFrame:
    """(plan_id, by, rooms2, union2, twice2): areas in square steps of all rooms together, of their union, and of what is claimed more than once.

    Slabs run between neighbouring abscissae of vertices and crossings. In a slab edges do not cross, so ordered by their middle the
    running sum of their directions is the number of rooms above each edge. by: columns of edges that tell apart what is measured
    for itself within a plan. slabs, if given, stands for slabs_of(edges).
    """
    slabs = slabs_of(edges) if slabs is None else slabs
    e = _counterclockwise(edges).where("ax <> bx").select("plan_id", *by, "room_ix", "eix", "ax", "ay", "bx", F.col("by_").alias("by"), "turn")
    s = slabs.join(e, "plan_id").where("least(ax, bx) <= x0 AND greatest(ax, bx) >= x1")
    s = s.select("plan_id", *by, "x0", "x1", "room_ix", "eix", F.expr("ay + (by - ay) * ((x0 + x1) / 2 - ax) / (bx - ax)").alias("y"), F.expr("turn * cast(sign(bx - ax) as int)").alias("up"))
    w = Window.partitionBy("plan_id", *by, "x0").orderBy("y", F.desc("up"), "room_ix", "eix")
    d = s.select("plan_id", *by, (F.col("x1") - F.col("x0")).alias("dx"), "y", F.sum("up").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("y").over(w).alias("y1")).where("y1 IS NOT NULL")
    area = F.col("dx") * (F.col("y1") - F.col("y"))
    return d.groupBy("plan_id", *by).agg(F.sum(area * F.col("depth")).alias("rooms2"), F.coalesce(F.sum(F.when(F.col("depth") > 0, area)), F.lit(0.0)).alias("union2"), F.coalesce(F.sum(F.when(F.col("depth") > 1, area * (F.col("depth") - 1))), F.lit(0.0)).alias("twice2"))


def lined(edges: DataFrame) -> DataFrame:
    """Edges with their line as an exact equi-join key (line kind, slope, offset) and their extent lo..hi along it.

    A quotient of two integers is rounded once, so equal lines have equal keys.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    e = edges.where("ax <> bx OR ay <> by_")
    return e.select(
        "plan_id", "room_ix", "eix", F.when(dx == 0, "v").otherwise("s").alias("line"), F.when(dx == 0, 0.0).otherwise(dy / dx + 0.0).alias("slope"),
        F.when(dx == 0, F.col("ax").cast("double")).otherwise((F.col("ay") * dx - F.col("ax") * dy) / dx + 0.0).alias("offset"),
        F.when(dx == 0, F.least("ay", "by_")).otherwise(F.least("ax", "bx")).alias("lo"), F.when(dx == 0, F.greatest("ay", "by_")).otherwise(F.greatest("ax", "bx")).alias("hi"),
    )


def shared_walls(edges: DataFrame) -> DataFrame:
    """(plan_id, a, b, run_m): the wall length that rooms a < b have in common, by an equi-join on the line."""
    e = lined(edges)
    o = e.select("plan_id", "line", "slope", "offset", F.col("room_ix").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    run = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    p = e.withColumnRenamed("room_ix", "a").join(o.hint("shuffle_hash"), ["plan_id", "line", "slope", "offset"]).where((F.col("a") < F.col("b")) & (run > 0))
    return p.groupBy("plan_id", "a", "b").agg((F.sum(run * F.when(F.col("line") == "v", 1.0).otherwise(F.sqrt(1 + F.col("slope") * F.col("slope")))) * STEP_M).alias("run_m"))


def shared_share(edges: DataFrame) -> DataFrame:
    """(plan_id, share): the part of all wall length that two rooms carry exactly, each such wall counted for both; 1 at most."""
    total = edges.groupBy("plan_id").agg((F.sum(M.length()) * STEP_M).alias("all_m"))
    runs = shared_walls(edges).groupBy("plan_id").agg(F.sum("run_m").alias("run_m"))
    return total.join(runs, "plan_id", "left").select("plan_id", F.least(F.lit(1.0), 2 * F.coalesce("run_m", F.lit(0.0)) / F.col("all_m")).alias("share"))


def edges_over_two(edges: DataFrame) -> DataFrame:
    """(plan_id, n): edges, whichever way they run, that more than two rooms carry."""
    ends = F.when((F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") <= F.col("by_"))), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("u"), F.col("by_").alias("v"))).otherwise(F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"), F.col("ax").alias("u"), F.col("ay").alias("v")))
    by = edges.select("plan_id", "room_ix", ends.alias("e")).groupBy("plan_id", "e").agg(F.countDistinct("room_ix").alias("rooms"))
    return by.groupBy("plan_id").agg(F.count_if(F.col("rooms") > 2).alias("n"))


#: Two wall faces, in metres: a first one from a to b, another from c to d. Expressions that any SQL engine can run.
SPAN, OTHER = "sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))", "sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy))"
START, END = (f"((bx - ax) * ({p}x - ax) + (by - ay) * ({p}y - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay))" for p in "cd")
FACE = {
    "cosine": f"abs((bx - ax) * (dx - cx) + (by - ay) * (dy - cy)) / ({SPAN} * {OTHER})",
    "run_m": f"(least(greatest({START}, {END}), 1.0) - greatest(least({START}, {END}), 0.0)) * {SPAN}",
    "gap_m": f"(abs((bx - ax) * (ay - cy) - (by - ay) * (ax - cx)) + abs((bx - ax) * (ay - dy) - (by - ay) * (ax - dx))) / {SPAN} / 2",
}
#: Faces whose boxes are within the reach r and that are long enough; then what must hold of the three measures.
NEAR = "least(ax, bx) - {r} <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, bx) + {r} AND least(ay, by) - {r} <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, by) + {r}"


def facing_pairs(edges: DataFrame, reach_m: float = 0.5, run_m: float = 0.3, degrees: float = 5.0) -> DataFrame:
    """(plan_id, a, b, gap_m, run_m): faces of two rooms a < b that are parallel within some degrees, at most reach_m apart, over at least run_m.

    The gap is the mean distance of the second face's ends from the first one's line; the run is what they share along it. Faces meet
    within a plan; boxes are compared first.
    """
    metres = lambda c: (F.col(c) * STEP_M)
    long = edges.where(M.length() * STEP_M >= run_m)
    left = long.select("plan_id", F.col("room_ix").alias("a"), *[metres(c).alias(n) for c, n in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by_", "by"))])
    right = long.select("plan_id", F.col("room_ix").alias("b"), *[metres(c).alias(n) for c, n in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by_", "dy"))])
    p = left.join(right, "plan_id").where(f"a < b AND {NEAR.format(r=reach_m)}").withColumns({n: F.expr(e) for n, e in FACE.items()})
    return p.where((F.col("cosine") >= math.cos(math.radians(degrees))) & (F.col("run_m") >= run_m - 1e-9) & (F.col("gap_m") <= reach_m + 1e-9)).select("plan_id", "a", "b", "gap_m", "run_m")


def wall_gaps(pairs: DataFrame, plans: DataFrame, default_m: float = 0.16) -> DataFrame:
    """(plan_id, q25, q50, q75): run-weighted quartiles of the gaps of facing walls; the default where a plan has none."""
    w = Window.partitionBy("plan_id").orderBy("gap_m")
    c = pairs.groupBy("plan_id", "gap_m").agg(F.sum("run_m").alias("run")).select("plan_id", "gap_m", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("run").over(Window.partitionBy("plan_id")).alias("total"))
    q = c.groupBy("plan_id").agg(*[F.min(F.when(F.col("upto") >= s * F.col("total") - 1e-9, F.col("gap_m"))).alias(f"q{int(100 * s)}") for s in (0.25, 0.5, 0.75)])
    return plans.select("plan_id").join(q, "plan_id", "left").select("plan_id", *[F.coalesce(c, F.lit(default_m)).alias(c) for c in ("q25", "q50", "q75")])


def slabs_of(edges: DataFrame) -> DataFrame:
    """(plan_id, x0, x1): the slabs between neighbouring abscissae of a plan's vertices and of crossings between its rooms."""
    own = edges.select("plan_id", F.col("ax").cast("double").alias("x0")).distinct()
    own = own.select("plan_id", "x0", F.lead("x0").over(Window.partitionBy("plan_id").orderBy("x0")).alias("x1")).where("x1 IS NOT NULL")
    more = crossing_points(edges).groupBy("plan_id").agg(F.collect_set("x").alias("more"))
    cut = own.join(more.hint("shuffle_hash"), "plan_id", "left").withColumn("more", F.expr("array_sort(filter(more, x -> x > x0 AND x < x1))"))
    marks = F.concat(F.array("x0"), F.coalesce("more", F.array().cast("array<double>")), F.array("x1"))
    n = F.size("x") - 1
    pairs = F.arrays_zip(F.slice("x", 1, n).alias("x0"), F.slice("x", 2, n).alias("x1"))
    return cut.select("plan_id", marks.alias("x")).select("plan_id", F.explode(pairs).alias("s")).select("plan_id", "s.x0", "s.x1")


def spans(edges: DataFrame, slabs: DataFrame | None = None) -> DataFrame:
    """(plan_id, x0, x1, room_ix, lo, hi, lo0, hi0, lo1, hi1): the ordinates between which a room lies (even-odd) at the middle and at both ends of each slab of a plan.

    No two rooms' edges cross inside a slab, so an area within it is the width times the length at the middle, exactly. slabs, if
    given, stands for slabs_of(edges).
    """
    slabs = slabs_of(edges) if slabs is None else slabs
    e = edges.where("ax <> bx").select(*M.ROOM, "eix", "ax", "ay", "bx", F.col("by_").alias("by"))
    at = lambda x: F.expr(f"ay + (by - ay) * ({x} - ax) / (bx - ax)")
    s = e.join(slabs.hint("shuffle_hash"), "plan_id").where("least(ax, bx) <= x0 AND greatest(ax, bx) >= x1").select(*M.ROOM, "x0", "x1", "eix", at("(x0 + x1) / 2").alias("lo"), at("x0").alias("lo0"), at("x1").alias("lo1"))
    w = Window.partitionBy(*M.ROOM, "x0").orderBy("lo", "eix")
    nxt = [F.lead(c).over(w).alias(n) for c, n in (("lo", "hi"), ("lo0", "hi0"), ("lo1", "hi1"))]
    return s.select("plan_id", "x0", "x1", "room_ix", "lo", "lo0", "lo1", *nxt, F.row_number().over(w).alias("k")).where("k % 2 = 1 AND hi > lo").drop("k")


def staged_spans(edges: DataFrame, n: int | None) -> tuple[DataFrame, DataFrame]:
    """slabs_of and spans of edges, each written once, in n buckets of plan_id: what reads them several times does not work them out again."""
    slabs = stage_by(slabs_of(edges), "plan_id", "slabs", n)
    return slabs, stage_by(spans(edges, slabs), "plan_id", "spans", n)


def lobes(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, lobe, area2): the areas, in square steps, into which a ring that crosses itself falls (even-odd); a simple ring has one.

    Slabs run between a ring's own vertices and crossings; pieces of neighbouring slabs are one lobe where they share a stretch of
    the line between.
    """
    ring = edges.withColumn("plan_id", F.struct(*M.ROOM))
    s = spans(ring.withColumn("room_ix", F.lit(0)), slabs_of(ring.withColumn("room_ix", F.col("eix")))).withColumn("piece", F.row_number().over(Window.partitionBy("plan_id").orderBy("x0", "lo")))
    right = s.select("plan_id", F.col("piece").alias("b"), F.col("x0").alias("x"), F.col("lo0").alias("rl"), F.col("hi0").alias("rh"))
    met = s.select("plan_id", F.col("piece").alias("a"), F.col("x1").alias("x"), "lo1", "hi1").join(right, ["plan_id", "x"]).where(F.least("hi1", "rh") - F.greatest("lo1", "rl") > 1e-9).select("plan_id", "a", "b")
    of = graph.components_within(met, s.select("plan_id", F.col("piece").alias("node"))).withColumnsRenamed({"node": "piece", "label": "lobe"})
    area = s.join(of, ["plan_id", "piece"]).groupBy("plan_id", "lobe").agg(F.sum((F.col("hi") - F.col("lo")) * (F.col("x1") - F.col("x0"))).alias("area2"))
    return area.select("plan_id.plan_id", "plan_id.room_ix", "lobe", "area2")


def repaired(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, lobes, area2, lost2): the largest lobe of each ring, which stands for the room, and the area of the others."""
    return lobes(edges).groupBy(*M.ROOM).agg(F.count(F.lit(1)).alias("lobes"), F.max("area2").alias("area2"), (F.sum("area2") - F.max("area2")).alias("lost2"))


def overlaps(edges: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """(plan_id, a, b, area2): the area, in square steps, that rooms a < b both claim, where it is more than rounding. s, if given, stands for spans(edges)."""
    s = spans(edges) if s is None else s
    p = s.join(near_rooms(edges).select("plan_id", F.col("a").alias("room_ix"), "b").hint("shuffle_hash"), M.ROOM).withColumnRenamed("room_ix", "a")
    o = s.select("plan_id", "x0", F.col("room_ix").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    p = o.join(p.hint("shuffle_hash"), ["plan_id", "b", "x0"]).where(both > 1e-9)
    return p.groupBy("plan_id", "a", "b").agg(F.sum(both * (F.col("x1") - F.col("x0"))).alias("area2"))


def swallowed_pairs(edges: DataFrame, share: float, n: int | None = None) -> DataFrame:
    """(plan_id, inner, outer): more than `share` of one room's area lies in another.

    Only rooms whose boxes share that much are laid over each other; they are few, and written in n buckets of plan_id, if given, so that
    no task holds all of the steps at once.
    """
    area = edges.groupBy(*M.ROOM).agg((F.abs(F.sum(M.cross())) / 2).alias("area"))
    ends = F.expr("inline(array(struct(a AS inner, b AS outer), struct(b AS inner, a AS outer)))")
    both = lambda t: t.select("plan_id", "shared", ends)
    within = lambda t: area.withColumnRenamed("room_ix", "inner").join(t.hint("shuffle_hash"), ["plan_id", "inner"])
    near = within(both(near_rooms(edges).withColumn("shared", F.col("x") * F.col("y")))).where(F.col("shared") > share * F.col("area"))
    some = near.select("plan_id", F.explode(F.array("inner", "outer")).alias("room_ix")).distinct()
    few = stage_by(edges.join(some.hint("shuffle_hash"), M.ROOM, "left_semi"), "plan_id", "few", n)
    found = overlaps(few, staged_spans(few, n)[1])
    return within(both(found.withColumnRenamed("area2", "shared"))).where(F.col("shared") > share * F.col("area")).select("plan_id", "inner", "outer")


def parts(rooms: DataFrame, edges: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """(plan_id, room_ix, part): rooms that share wall length or area are one part of the floor; the part is its smallest room. s, if given, stands for spans(edges)."""
    walls = shared_walls(edges).select("plan_id", "a", "b")
    links = walls.unionByName(overlaps(edges, s).select("plan_id", "a", "b"))
    return graph.room_components(rooms, links, "true").withColumnRenamed("root", "part")


def part_areas(s: DataFrame, part: DataFrame) -> DataFrame:
    """(plan_id, part, union2, twice2): the area in square steps that each part of a floor covers, and what its rooms claim beyond that, from spans. A part without area has no row."""
    w = Window.partitionBy("plan_id", "part", "x0").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    c = s.join(part.hint("shuffle_hash"), M.ROOM).select("plan_id", "part", "x0", "x1", "lo", "hi").withColumn("upto", F.max("hi").over(w))
    new = F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", F.coalesce("upto", "lo")))
    wide = F.col("x1") - F.col("x0")
    return c.groupBy("plan_id", "part").agg(F.sum(wide * new).alias("union2"), F.sum(wide * (F.col("hi") - F.col("lo") - new)).alias("twice2"))


def home_parts(rooms: DataFrame, edges: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """(plan_id, parts, rooms_outside, area_outside): how many parts a floor has, and what lies in others than the largest (ties: the one of the smaller room)."""
    area = edges.groupBy(*M.ROOM).agg((F.abs(F.sum(M.cross())) / 2 * STEP_M * STEP_M).alias("area"))
    per = parts(rooms, edges, s).join(area, M.ROOM).groupBy("plan_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc(F.round("area", 9)), "part"))
    outside = lambda c: F.sum(F.when(F.col("rank") > 1, F.col(c)).otherwise(0))
    return per.withColumn("rank", rank).groupBy("plan_id").agg(F.count(F.lit(1)).alias("parts"), outside("n").alias("rooms_outside"), outside("area").alias("area_outside"))


def entry_from_shared_wall(edges: DataFrame, access: DataFrame) -> DataFrame:
    """(plan_id, x_m, y_m): the middle, by length, of the wall that the rooms of a plan's first entrance link share; links whose rooms share none are passed over."""
    e = lined(edges)
    o = e.select("plan_id", "line", "slope", "offset", F.col("room_ix").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    lo, hi = F.greatest("lo", "lo2"), F.least("hi", "hi2")
    p = e.withColumnRenamed("room_ix", "a").join(o, ["plan_id", "line", "slope", "offset"]).where((F.col("a") != F.col("b")) & (hi > lo))
    up, mid = F.col("line") == "v", (lo + hi) / 2
    p = p.select("plan_id", "a", "b", ((hi - lo) * F.when(up, 1.0).otherwise(F.sqrt(1 + F.col("slope") * F.col("slope")))).alias("len"), F.when(up, F.col("offset")).otherwise(mid).alias("x"), F.when(up, mid).otherwise(F.col("slope") * mid + F.col("offset")).alias("y"))
    at = access.where("kind = 'entrance'").join(p, ["plan_id", "a", "b"]).groupBy("plan_id", "edge_ix").agg((F.sum(F.col("x") * F.col("len")) / F.sum("len")).alias("x"), (F.sum(F.col("y") * F.col("len")) / F.sum("len")).alias("y"))
    first = at.groupBy("plan_id").agg(F.min_by(F.struct("x", "y"), "edge_ix").alias("m"))
    return first.select("plan_id", (F.col("m.x") * STEP_M).alias("x_m"), (F.col("m.y") * STEP_M).alias("y_m"))


def area_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """(plan_id, mean_error, drift): the mean of the rooms' area changes and the change of the whole, each against the area before. Both are edge tables."""
    area = lambda e, n: e.groupBy(*M.ROOM).agg((F.abs(F.sum(M.cross())) / 2).alias(n))
    j = area(before, "a").join(area(after, "b"), M.ROOM, "left")
    error = F.avg(F.when((F.col("a") > 0) & F.col("b").isNotNull(), F.abs(F.col("b") - F.col("a")) / F.col("a")))
    return j.groupBy("plan_id").agg(F.coalesce(error, F.lit(0.0)).alias("mean_error"), F.coalesce(F.try_divide(F.abs(F.sum(F.coalesce("b", F.lit(0.0))) - F.sum("a")), F.sum("a")), F.lit(0.0)).alias("drift"))


def fill_nearest(cells: DataFrame, inside: DataFrame) -> DataFrame:
    """inside (plan_id, cx, cy) with room_ix: a cell's own room, else that of the nearest cell that has one (ties: the lower, then the left one).

    Two passes, as distance transforms have them: in each column the nearest labelled cells above and below, then for each cell the
    best of its row over the columns. Labelled cells outside `inside` do not count.
    """
    grid = inside.join(cells, ["plan_id", "cx", "cy"], "left").select("plan_id", "cx", "cy", "room_ix")
    here = F.when(F.col("room_ix").isNotNull(), F.struct(F.col("cy").alias("y"), "room_ix"))
    w = Window.partitionBy("plan_id", "cx").orderBy("cy")
    seen = grid.select("*", F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("under"), F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("over"))
    found = seen.select("plan_id", "cy", F.col("cx").alias("x"), F.explode(F.array("under", "over")).alias("c")).where("c IS NOT NULL").distinct()
    open_ = seen.where("room_ix IS NULL").select("plan_id", "cx", "cy")
    j = open_.join(found, ["plan_id", "cy"])
    d2 = (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("c.y")) * (F.col("cy") - F.col("c.y"))
    filled = j.groupBy("plan_id", "cx", "cy").agg(F.min_by("c.room_ix", F.struct(d2.alias("d2"), F.col("c.y").alias("y"), "x")).alias("room_ix"))
    return grid.where("room_ix IS NOT NULL").unionByName(filled)


def room_cells(edges: DataFrame, step: int) -> DataFrame:
    """(plan_id, room_ix, cx, cy): grid cells of `step` lattice steps whose centre lies inside a room (even-odd).

    Each edge is laid over the columns of cells that it spans; in a column, cells between one edge and the next are inside by turns.
    """
    e = edges.where("ax <> bx").select(*M.ROOM, "ax", "ay", "bx", F.col("by_").alias("by"))
    cols = e.withColumn("c0", F.ceil(F.least("ax", "bx") / step - 0.5)).withColumn("c1", F.ceil(F.greatest("ax", "bx") / step - 0.5) - 1).where("c1 >= c0").select("*", F.explode(F.sequence("c0", "c1")).alias("cx"))
    y = cols.select(*M.ROOM, "cx", F.expr(f"ay + (by - ay) * ((cx + 0.5) * {step} - ax) / (bx - ax)").alias("y"))
    w = Window.partitionBy(*M.ROOM, "cx").orderBy("y")
    spans = y.select(*M.ROOM, "cx", "y", F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("k")).where("k % 2 = 1 AND y1 IS NOT NULL")
    spans = spans.withColumn("r0", F.ceil(F.col("y") / step - 0.5)).withColumn("r1", F.ceil(F.col("y1") / step - 0.5) - 1).where("r1 >= r0")
    return spans.select(*M.ROOM, "cx", F.explode(F.sequence("r0", "r1")).alias("cy"))


def raster(edges: DataFrame, step: int) -> DataFrame:
    """(plan_id, cx, cy, room_ix): room_cells with the lowest room where rooms overlap."""
    return room_cells(edges, step).groupBy("plan_id", "cx", "cy").agg(F.min("room_ix").alias("room_ix"))
