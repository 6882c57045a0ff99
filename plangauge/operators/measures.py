"""Ring and plan measures over the edge table (plan_id, room_ix, category, eix, ax, ay, bx, by_), in lattice steps.

All windows and groups run on plan_id or a finer key, so a table that is partitioned by plan_id needs no further exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core.constants import STEP_M
from plangauge.core.dimensions import tag_of

ROOM = ["plan_id", "room_ix"]


def quantise(x: Column) -> Column:
    """Metres to lattice steps, half to even."""
    return F.rint(x / STEP_M).cast("long")


def cross() -> Column:
    return F.col("ax") * F.col("by_") - F.col("bx") * F.col("ay")


def length() -> Column:
    return F.sqrt(((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by_") - F.col("ay")) * (F.col("by_") - F.col("ay"))).cast("double"))


def edges_of(vertices: DataFrame) -> DataFrame:
    """The segments of each ring, the last one closing it."""
    w = Window.partitionBy(*ROOM).orderBy("vix")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = lambda c: F.coalesce(F.lead(c).over(w), first(c))
    return vertices.select(*ROOM, "category", F.col("vix").alias("eix"), F.col("ix").alias("ax"), F.col("iy").alias("ay"), nxt("ix").alias("bx"), nxt("iy").alias("by_"))


def closed(vertices: DataFrame) -> DataFrame:
    """Rings without vertices that repeat the one before, and without a closing repeat of the first; numbered anew."""
    w = Window.partitionBy(*ROOM).orderBy("vix")
    here = F.struct("ix", "iy")
    prev = F.lag(here).over(w)
    kept = vertices.withColumn("_p", prev).where("_p IS NULL OR _p.ix <> ix OR _p.iy <> iy").drop("_p")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = kept.withColumn("_f", F.first(here).over(full)).withColumn("_n", F.count(F.lit(1)).over(full)).withColumn("_k", F.row_number().over(w))
    kept = kept.where("NOT (_k = _n AND _n > 1 AND _f.ix = ix AND _f.iy = iy)")
    return kept.select(*ROOM, "category", (F.col("_k") - 1).cast("int").alias("vix"), "ix", "iy")


def walls(edges: DataFrame) -> DataFrame:
    """Edges of some length, numbered anew along each ring, as if no vertex repeated the one before; a ring of one point keeps one edge."""
    w = Window.partitionBy(*ROOM).orderBy("eix")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by_"))).cast("int")
    k = edges.withColumn("_long", some).withColumn("_n", F.sum("_long").over(full)).withColumn("_k", F.sum("_long").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w))
    kept = k.where("_long = 1 OR (_n = 0 AND _i = 1)")
    return kept.withColumn("eix", F.greatest(F.col("_k") - 1, F.lit(0)).cast("int")).drop("_long", "_n", "_k", "_i")


def oriented(vertices: DataFrame) -> DataFrame:
    """Rings counter-clockwise; rings of no area stay as they are."""
    area = edges_of(vertices).groupBy(*ROOM).agg(F.sum(cross()).alias("area2"), F.count(F.lit(1)).alias("n"))
    turned = vertices.join(area, ROOM)
    return turned.select(*ROOM, "category", F.when(F.col("area2") < 0, F.col("n") - 1 - F.col("vix")).otherwise(F.col("vix")).cast("int").alias("vix"), "ix", "iy")


def room_measures(edges: DataFrame) -> DataFrame:
    """One row per room: area2 (twice the signed area), perimeter, bounding sides, compactness, squareness, tag."""
    m = edges.groupBy(*ROOM, "category").agg(
        F.sum(cross()).alias("area2"), F.sum(length()).alias("per"), F.count(F.lit(1)).alias("n"),
        F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"),
    )
    a, p, wide, high = F.abs("area2") / 2.0, F.col("per"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short, long = F.least(wide, high), F.greatest(wide, high)
    return m.select(
        *ROOM, "category", tag_of(F.col("category")).alias("tag"), "area2", "n", (a * STEP_M * STEP_M).alias("area_m2"), (p * STEP_M).alias("perimeter_m"),
        F.when(p > 0, 4 * math.pi * a / (p * p)).otherwise(0.0).alias("pp"), (short * STEP_M).alias("short_m"), (long * STEP_M).alias("long_m"),
        F.when(long > 0, short / long).otherwise(0.0).alias("squareness"), "x0", "x1", "y0", "y1",
    )


def dominant_direction(edges: DataFrame) -> DataFrame:
    """(plan_id, angle): the length-weighted circular mean of four times the wall angles, over four."""
    four = 4 * F.atan2((F.col("by_") - F.col("ay")).cast("double"), (F.col("bx") - F.col("ax")).cast("double"))
    s, c = F.sum(length() * F.sin(four)), F.sum(length() * F.cos(four))
    return edges.groupBy("plan_id").agg((F.atan2(s, c) / 4).alias("angle"))


def rotated_boxes(edges: DataFrame, angles: DataFrame) -> DataFrame:
    """(plan_id, room_ix, min_width_m, long_m): bounding sides in the plan's dominant frame."""
    e = edges.join(angles, "plan_id")
    c, s = F.cos("angle"), F.sin("angle")
    u, v = F.col("ax") * c + F.col("ay") * s, F.col("ay") * c - F.col("ax") * s
    box = e.groupBy(*ROOM, "category").agg((F.max(u) - F.min(u)).alias("du"), (F.max(v) - F.min(v)).alias("dv"))
    return box.select(*ROOM, "category", (F.least("du", "dv") * STEP_M).alias("min_width_m"), (F.greatest("du", "dv") * STEP_M).alias("long_m"))


def off_axis_share(edges: DataFrame, degrees: float = 2.0) -> DataFrame:
    """(plan_id, off_axis): the share of wall length more than `degrees` off both axes."""
    a = F.pmod(F.atan2((F.col("by_") - F.col("ay")).cast("double"), (F.col("bx") - F.col("ax")).cast("double")), F.lit(math.pi / 2))
    off = F.least(a, F.lit(math.pi / 2) - a) > math.radians(degrees)
    return edges.groupBy("plan_id").agg((F.coalesce(F.sum(F.when(off, length())), F.lit(0.0)) / F.sum(length())).alias("off_axis"))


def centroids(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, cx_m, cy_m): area-weighted, or the mean vertex where there is no area."""
    a = edges.groupBy(*ROOM).agg(F.sum(cross()).alias("a2"), F.sum((F.col("ax") + F.col("bx")) * cross()).alias("sx"), F.sum((F.col("ay") + F.col("by_")) * cross()).alias("sy"), F.avg("ax").alias("mx"), F.avg("ay").alias("my"))
    pick = lambda s, m: (F.when(F.col("a2") != 0, F.col(s) / (3.0 * F.col("a2"))).otherwise(F.col(m)) * STEP_M)
    return a.select(*ROOM, pick("sx", "mx").alias("cx_m"), pick("sy", "my").alias("cy_m"))


def rectangularity(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, rect): area over that of the smallest rotated rectangle; directions of all vertex pairs hold those of the hull."""
    v = edges.select(*ROOM, "eix", "ax", "ay")
    p = v.join(v.select(*ROOM, F.col("eix").alias("e2"), F.col("ax").alias("ox"), F.col("ay").alias("oy")), ROOM).where("eix < e2")
    d = p.select(*ROOM, "eix", "e2", (F.col("ox") - F.col("ax")).alias("dx"), (F.col("oy") - F.col("ay")).alias("dy")).where("dx <> 0 OR dy <> 0")
    on = d.join(v.select(*ROOM, "ax", "ay"), ROOM)
    u, w = F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy"), F.col("ay") * F.col("dx") - F.col("ax") * F.col("dy")
    box = on.groupBy(*ROOM, "eix", "e2", "dx", "dy").agg(((F.max(u) - F.min(u)).cast("double") * (F.max(w) - F.min(w))).alias("uw"))
    least = box.groupBy(*ROOM).agg(F.min(F.col("uw") / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("least"))
    area = edges.groupBy(*ROOM).agg((F.abs(F.sum(cross())) / 2.0).alias("a"))
    return area.join(least, ROOM, "left").select(*ROOM, F.when(F.col("least") > 0, F.col("a") / F.col("least")).otherwise(0.0).alias("rect"))


def without_collinear(vertices: DataFrame) -> DataFrame:
    """Drop a vertex where every ring of the plan that has it finds it exactly flat; a ring left with under three vertices stays whole."""
    w = Window.partitionBy(*ROOM).orderBy("vix")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda f, c, e: F.coalesce(f(c).over(w), e(c).over(full))
    n = vertices.select("*", *[at(F.lag, c, F.last).alias(f"p{c}") for c in ("ix", "iy")], *[at(F.lead, c, F.first).alias(f"n{c}") for c in ("ix", "iy")], F.count(F.lit(1)).over(full).alias("_n"))
    flat = (F.col("_n") >= 3) & ((F.col("ix") - F.col("pix")) * (F.col("niy") - F.col("iy")) == (F.col("iy") - F.col("piy")) * (F.col("nix") - F.col("ix")))
    n = n.withColumn("_drop", F.bool_and(flat).over(Window.partitionBy("plan_id", "ix", "iy")))
    n = n.withColumn("_left", F.sum(F.when(F.col("_drop"), 0).otherwise(1)).over(Window.partitionBy(*ROOM)))
    kept = n.where("NOT _drop OR _left < 3")
    return kept.select(*ROOM, "category", (F.row_number().over(w) - 1).cast("int").alias("vix"), "ix", "iy")


def crossings(edges: DataFrame) -> DataFrame:
    """(plan_id, room_ix, n): pairs of edges of one ring that are not neighbours and yet meet. Edges of no length would part neighbours: see walls."""
    other = edges.select(*ROOM, F.col("eix").alias("e2"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by_").alias("dy"))
    count = Window.partitionBy(*ROOM)
    mine = edges.withColumn("k", F.count(F.lit(1)).over(count))
    boxes = "least(ax, bx) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, bx) AND least(ay, by_) <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, by_)"
    pairs = mine.join(other, ROOM).where(f"eix + 1 < e2 AND NOT (eix = 0 AND e2 = k - 1) AND {boxes}")
    o = lambda p, q, r: f"sign(cast(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x) as double))"
    q = pairs.select(*ROOM, F.col("ax").alias("ax"), F.col("ay"), F.col("bx"), F.col("by_").alias("by"), "cx", "cy", "dx", "dy")
    q = q.select("*", *[F.expr(o(*t)).alias(n) for n, t in (("o1", "abc"), ("o2", "abd"), ("o3", "cda"), ("o4", "cdb"))])
    touch = lambda s, p, a, b: f"({s} = 0 AND {p}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {p}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y))"
    meet = f"(o1 * o2 < 0 AND o3 * o4 < 0) OR {touch('o1', 'c', 'a', 'b')} OR {touch('o2', 'd', 'a', 'b')} OR {touch('o3', 'a', 'c', 'd')} OR {touch('o4', 'b', 'c', 'd')}"
    return q.where(meet).groupBy(*ROOM).agg(F.count(F.lit(1)).alias("n"))
