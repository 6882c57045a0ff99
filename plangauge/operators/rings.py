"""Ordered rings from sets of edges: the outline and the holes of a floor, and the entry on its outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core.constants import STEP_M
from plangauge.core.staging import stage_by
from plangauge.operators import coverage as V

#: Parts of a step that points are kept in, so that ends which meet are equal; and how far, in steps, a vertex may lie off a straight wall.
GRAIN, STRAIGHT = 1_000_000, 1e-5


def union_spans(edges: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """(plan_id, x0, x1, lo0, lo1, hi0, hi1): the ordinates between which a floor has any room, at both ends of each slab."""
    s = V.spans(edges) if s is None else s
    w = Window.partitionBy("plan_id", "x0").orderBy("lo", "hi")
    above = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1e15))
    s = s.withColumn("_i", F.sum((F.col("lo") > above + 1e-9).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.min(F.struct("lo", "lo0", "lo1")).alias("l"), F.max(F.struct("hi", "hi0", "hi1")).alias("h")
    return s.groupBy("plan_id", "x0", "x1", "_i").agg(low, high).select("plan_id", "x0", "x1", "l.lo0", "l.lo1", "h.hi0", "h.hi1")


def boundary(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(plan_id, id, ax, ay, bx, by): the directed pieces, in grains, that bound a floor, which lies to their left. What two rooms share cancels.

    Between abscissae they are the lower and upper ends of the spans; on an abscissa, the stretches with floor on one side only. Pieces are
    numbered from 0 by their ends. They are written, in n buckets of plan_id if n is given.
    """
    u = union_spans(edges, V.staged_spans(edges, n)[1]).withColumns({c: F.round(F.col(c) * GRAIN).cast("long") for c in ("x0", "x1", "lo0", "lo1", "hi0", "hi1")})
    ends = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("ax", "ay", "bx", "by"), strict=True)])
    along = u.select("plan_id", F.explode(F.array(ends("x0", "lo0", "x1", "lo1"), ends("x1", "hi1", "x0", "hi0"))).alias("p")).select("plan_id", "p.*")
    event = lambda x, y, left, right: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    marks = u.select("plan_id", F.explode(F.array(event("x0", "lo0", 0, 1), event("x0", "hi0", 0, -1), event("x1", "lo1", 1, 0), event("x1", "hi1", -1, 0))).alias("e")).select("plan_id", "e.*")
    w = Window.partitionBy("plan_id", "x").orderBy("y")
    upto = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0
    at = marks.groupBy("plan_id", "x", "y").agg(F.sum("left").alias("left"), F.sum("right").alias("right")).select("plan_id", "x", "y", F.lead("y").over(w).alias("y1"), upto("left").alias("left"), upto("right").alias("right"))
    up = at.where("left <> right AND y1 IS NOT NULL").select("plan_id", F.col("x").alias("ax"), F.expr("if(left, y, y1)").alias("ay"), F.col("x").alias("bx"), F.expr("if(left, y1, y)").alias("by"))
    # a plan's pieces are one array of it, so that their union and their numbers need no shuffle
    listed = lambda t, name: t.where("ax <> bx OR ay <> by").groupBy("plan_id").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias(name))
    none = F.array().cast("array<struct<ax:bigint,ay:bigint,bx:bigint,by:bigint>>")
    both = listed(along, "p").join(listed(up, "q"), "plan_id", "full").select("plan_id", F.array_sort(F.concat(F.coalesce("p", none), F.coalesce("q", none))).alias("p"))
    return stage_by(both.select("plan_id", F.posexplode("p").alias("id", "p")).select("plan_id", F.col("id").cast("long").alias("id"), "p.*"), "plan_id", "pieces", n)


def followed(pieces: DataFrame) -> DataFrame:
    """(plan_id, id, next): the piece that goes on where each ends.

    Where several pieces meet in a point, one that ends there is followed by the nearest to its right-hand turn back: both bound the same wedge of
    floor, so that parts which touch in a point only are rings of their own.
    """
    w = Window.partitionBy("plan_id", "x", "y")
    ends = pieces.select("plan_id", "id", F.col("bx").alias("x"), F.col("by").alias("y"), F.expr("atan2(ay - by, ax - bx)").alias("angle"))
    ends = ends.select("*", F.row_number().over(w.orderBy("angle")).alias("k"), F.min("angle").over(w).alias("first"), F.count(F.lit(1)).over(w).alias("n"))
    starts = pieces.select("plan_id", F.col("id").alias("next"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.expr("atan2(by - ay, bx - ax)").alias("angle"))
    starts = starts.select("plan_id", "next", "x", "y", F.row_number().over(w.orderBy("angle")).alias("turn"), F.min("angle").over(w).alias("least"))
    turn = F.when(F.col("least") < F.col("first"), F.col("k")).otherwise((F.col("k") - 2 + F.col("n")) % F.col("n") + 1)
    return ends.join(starts, ["plan_id", "x", "y"]).where(F.col("turn") == turn).select("plan_id", "id", "next")


def ordered(links: DataFrame) -> DataFrame:
    """(plan_id, id, start, pos) of links (plan_id, id, next) that form cycles, ids from 0 without gaps: the least id of the cycle and the steps from there.

    Pointer doubling within the array of a plan: the number of rounds is the logarithm of the number of its links.
    """
    a = links.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "next"))), lambda x: x["next"]).alias("next"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("next"))).cast("int") + 1)
    at = lambda values, i: F.get(values, i)

    def lower(s: Column, _: Column) -> Column:
        return F.struct(F.transform(s["to"], lambda j: at(s["to"], j)).alias("to"), F.transform(s["to"], lambda j, i: F.least(at(s["least"], i), at(s["least"], j))).alias("least"))

    def farther(s: Column, _: Column) -> Column:
        return F.struct(F.transform(s["to"], lambda j: at(s["to"], j)).alias("to"), F.transform(s["to"], lambda j, i: at(s["left"], i) + F.coalesce(at(s["left"], j), F.lit(0))).alias("left"))

    a = a.withColumn("start", F.aggregate(rounds, F.struct(F.col("next").alias("to"), F.transform("next", lambda j, i: F.least(j, i)).alias("least")), lower, lambda s: s["least"]))
    cut = F.transform("next", lambda j, i: F.when(j != at(F.col("start"), i), j))  # the last link of a cycle leads nowhere
    a = a.withColumn("to", cut).withColumn("left", F.aggregate(rounds, F.struct("to", F.transform("to", lambda j: F.when(j.isNotNull(), 1).otherwise(0)).alias("left")), farther, lambda s: s["left"]))
    a = a.withColumn("pos", F.transform("left", lambda d, i: at(F.col("left"), at(F.col("start"), i)) - d))
    return a.select("plan_id", F.posexplode(F.arrays_zip("start", "pos")).alias("id", "x")).select("plan_id", "id", "x.start", "x.pos")


def outlines(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(plan_id, ring, seq, x, y, area2): the rings, in steps, that bound the rooms of a plan together; outer ones run counter-clockwise, holes clockwise.

    Rings are numbered in the order of their least vertex, where each begins; area2 is negative for holes. Vertices on a straight wall are left out.
    """
    p = boundary(edges, n)
    v = ordered(followed(p)).join(p, ["plan_id", "id"])
    w, whole = Window.partitionBy("plan_id", "start").orderBy("pos"), Window.partitionBy("plan_id", "start").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = lambda c: F.col(c) / GRAIN
    last = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) / GRAIN
    v = v.select("plan_id", "start", "pos", here("ax").alias("x"), here("ay").alias("y"), here("bx").alias("nx"), here("by").alias("ny"), last("ax").alias("px"), last("ay").alias("py"))
    off = F.expr("abs((nx - px) * (y - py) - (ny - py) * (x - px))")
    v = v.withColumn("area2", F.sum(F.expr("(x * ny - nx * y) / 2")).over(Window.partitionBy("plan_id", "start")))
    v = v.where(off > STRAIGHT * F.expr("sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py))"))
    ring = F.dense_rank().over(Window.partitionBy("plan_id").orderBy("start")) - 1
    return v.select("plan_id", ring.alias("ring"), (F.row_number().over(w) - 1).alias("seq"), "x", "y", "area2")


def entry_on_outline(rings: DataFrame, points: DataFrame) -> DataFrame:
    """(plan_id, edge, station, x_m, y_m, offset_m, synthetic): where the outline (the outer ring of most area) is nearest to a plan's point.

    points: plan_id, px, py in steps. A plan without a row there, or with a null, takes the middle of its longest edge, `synthetic`, with
    no offset. Ties go to the earlier edge. rings are those of outlines().
    """
    home = rings.where("area2 > 0").groupBy("plan_id").agg(F.max_by("ring", F.struct(F.round("area2", 6), -F.col("ring"))).alias("ring"))
    w = Window.partitionBy("plan_id").orderBy("seq")
    o = rings.join(home, ["plan_id", "ring"])
    turn = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    e = o.select("plan_id", F.col("seq").alias("edge"), "x", "y", (turn("x") - F.col("x")).alias("dx"), (turn("y") - F.col("y")).alias("dy")).join(points.select("plan_id", "px", "py"), "plan_id", "left")
    e = e.withColumn("synthetic", F.expr("px IS NULL OR py IS NULL"))
    t = F.expr("if(synthetic, 0.5D, least(1D, greatest(0D, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))))")
    e = e.withColumn("station", t).withColumn("qx", F.expr("x + station * dx")).withColumn("qy", F.expr("y + station * dy"))
    e = e.withColumn("d", F.expr("if(synthetic, 0D, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)))"))
    first = F.struct(F.round(F.expr("if(synthetic, -sqrt(dx * dx + dy * dy), d)"), 6), "edge")
    best = e.groupBy("plan_id").agg(F.min_by(F.struct("edge", "station", "qx", "qy", "d", "synthetic"), first).alias("b"))
    metres = lambda c, n: (F.col(f"b.{c}") * STEP_M).alias(n)
    return best.select("plan_id", "b.edge", "b.station", metres("qx", "x_m"), metres("qy", "y_m"), metres("d", "offset_m"), "b.synthetic")
