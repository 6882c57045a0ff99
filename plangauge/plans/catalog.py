"""Registered queries over the derived plan tables, each beside its SQL. Names begin with the operator's place in the inventory."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core import dimensions as D
from plangauge.core.staging import stage, stage_by
from plangauge.operators import calibration as C
from plangauge.operators import coverage as V
from plangauge.operators import graph as G
from plangauge.operators import ladder as L
from plangauge.operators import measures as M
from plangauge.operators import outcomes as O
from plangauge.sources import bridge
from plangauge.sources.bridge import staged_edges, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: For SQL only: the derived tables, each worked out once.
B = bridge.ctes().replace("vertices AS (\n  SELECT plan_id", "vertices AS MATERIALIZED (\n  SELECT plan_id").replace("edges AS (", "edges AS MATERIALIZED (").replace("rooms AS (", "rooms AS MATERIALIZED (")
S = repr(K.STEP_M)


def register(sql: str | None = None):
    """Add a query under its function's name, with its SQL where there is one."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    """Six decimals; the nudge keeps exact halves (multiples of a dyadic step) from falling either way with the last bit."""
    return (F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(name or c)


def q6(c: str, name: str | None = None) -> str:
    return f"round({c} + 1e-9, 6) + 0.0 AS {name or c}"


# ---- SQL building blocks -------------------------------------------------------------------------------------------------

LEN = "sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE))"
ROOMS_SQL = f"""{B},
m AS (SELECT plan_id, room_ix, category, {D.tag_sql()} AS tag, count(*) AS n, CAST(sum(ax * by_ - bx * ay) AS BIGINT) AS area2, sum({LEN}) AS per, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edges GROUP BY plan_id, room_ix, category),
r AS (SELECT *, abs(area2) / 2.0 * {S} * {S} AS area_m2, per * {S} AS perimeter_m, 4 * pi() * (abs(area2) / 2.0) / (per * per) AS pp,
  least(x1 - x0, y1 - y0) * {S} AS short_m, greatest(x1 - x0, y1 - y0) * {S} AS long_m, CAST(least(x1 - x0, y1 - y0) AS DOUBLE) / greatest(x1 - x0, y1 - y0) AS squareness FROM m)"""
OFF = f"abs(bx - ax) * {S} > 0.001 AND abs(by_ - ay) * {S} > 0.001"
LADDER_SQL = f"""{ROOMS_SQL},
floors AS (SELECT * FROM {D.floors_sql()}),
limits AS (SELECT DISTINCT kind, compactness FROM floors),
off AS (SELECT DISTINCT plan_id, room_ix FROM edges WHERE {OFF}),
f AS (SELECT r.*, p.grp, p.kind, l.compactness, round(r.pp, 9) AS score, o.room_ix IS NOT NULL AND r.tag <> 'Hallway' AS off_axis,
    CASE WHEN r.tag IN ('Bedroom', 'PrimaryBedroom') THEN least(fl.prop_req, 0.6) ELSE fl.prop_req END AS floor
  FROM r JOIN plans p ON p.plan_id = r.plan_id JOIN limits l ON l.kind = p.kind LEFT JOIN floors fl ON fl.kind = p.kind AND fl.tag = r.tag LEFT JOIN off o ON o.plan_id = r.plan_id AND o.room_ix = r.room_ix),
g0 AS (SELECT plan_id, grp, kind, any_value(compactness) AS compactness, count(*) AS rooms, min(CASE WHEN tag <> 'Hallway' THEN score END) AS score,
    min(CASE WHEN floor IS NOT NULL THEN round(squareness - floor, 9) END) AS margin, bool_or(off_axis) AS off_axis FROM f GROUP BY plan_id, grp, kind),
g AS (SELECT *, coalesce(score < compactness, FALSE) AS f2, coalesce(margin < -0.001, FALSE) AS f3, off_axis AS f4 FROM g0),
graded AS (SELECT *, CASE WHEN f2 THEN 'roomCompactness' WHEN f3 THEN 'roomProportions' END AS stopped_at, CASE WHEN NOT f2 AND NOT f3 AND f4 THEN 'roomAppendices' END AS not_run,
    CASE WHEN f2 OR f3 THEN FALSE WHEN f4 THEN NULL ELSE TRUE END AS passed FROM g)"""
EVENT_SQL = """v AS (SELECT CASE event_type WHEN 'click' THEN 'rplan' WHEN 'view' THEN 'msd units' WHEN 'purchase' THEN 'houseganpp' WHEN 'signup' THEN 'housegan' ELSE 'housediffusion' END AS grp,
  user_id AS cluster, event_id % 11 <> 0 AS admitted, CASE WHEN event_id % 7 = 0 THEN 'roomAppendices' END AS not_run, value < 40 AND event_id % 11 <> 0 AND event_id % 7 <> 0 AS passed FROM events)"""
CELLS_SQL = f"""{EVENT_SQL},
c AS (SELECT grp, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) FILTER (admitted) AS admitted, count(*) FILTER (admitted AND not_run IS NULL) AS verdict FROM v GROUP BY grp),
rt AS (SELECT grp, passed, 'graded' AS denominator, graded AS total FROM c UNION ALL SELECT grp, passed, 'admitted', admitted FROM c UNION ALL SELECT grp, passed, 'verdict', verdict FROM c)"""
Z = repr(K.Z95)


def wilson_sql(p: str, n: str) -> str:
    half = f"{Z} * sqrt(({p} / CAST({n} AS DOUBLE)) * (1 - {p} / CAST({n} AS DOUBLE)) / {n} + {Z} * {Z} / (4.0 * {n} * {n}))"
    centre = f"{p} / CAST({n} AS DOUBLE) + {Z} * {Z} / (2.0 * {n})"
    return f"100 * {p} / CAST({n} AS DOUBLE) AS rate, 100 * ({centre} - {half}) / (1 + {Z} * {Z} / {n}) AS low, 100 * ({centre} + {half}) / (1 + {Z} * {Z} / {n}) AS high"


ROLES_SQL = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{r}')" for g, _, r in K.GROUPS) + ") AS x(grp, role))"


def _rooms(spark: SparkSession, sf: str) -> DataFrame:
    return M.room_measures(table(spark, sf, "edges"))


def _graded(spark: SparkSession, sf: str, suppress: tuple[str, ...] = ()) -> DataFrame:
    """The ladder over all plans; edges are derived once and written, as three measures read them."""
    facts = L.room_facts(stage(table(spark, sf, "edges").select("plan_id", "room_ix", "category", "eix", "ax", "ay", "bx", "by_"), "edges"))
    return L.grade(L.rung_inputs(table(spark, sf, "plans"), facts, D.floors(spark)), suppress)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on events: statistics that need no geometry."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    grp = F.when(F.col("event_type") == "click", "rplan").when(F.col("event_type") == "view", "msd units").when(F.col("event_type") == "purchase", "houseganpp").when(F.col("event_type") == "signup", "housegan").otherwise("housediffusion")
    admitted, ran = F.expr("event_id % 11 <> 0"), F.expr("event_id % 7 <> 0")
    return e.select(grp.alias("grp"), F.col("user_id").alias("cluster"), admitted.alias("admitted"), F.when(~ran, "roomAppendices").alias("not_run"), ((F.col("value") < 40) & admitted & ran).alias("passed"))


# ---- C: ring measures ----------------------------------------------------------------------------------------------------


@register(f"WITH {B} SELECT plan_id, room_ix, vix, ix, iy FROM vertices")
def c01_close_ring(spark, sf):
    v = table(spark, sf, "vertices")
    twice = v.unionByName(v.where("vix % 3 = 1 OR vix = 0")).withColumn("vix", F.col("vix") * 2)
    w = M.Window.partitionBy("plan_id", "room_ix").orderBy("vix")
    doubled = twice.withColumn("vix", F.row_number().over(w))
    last = v.where("vix = 0").withColumn("vix", F.lit(1000))
    return M.closed(doubled.unionByName(last)).select("plan_id", "room_ix", "vix", "ix", "iy")


@register(f"WITH {B} SELECT plan_id, room_ix, vix, ix AS qx, iy AS qy FROM vertices")
def c02_quantise(spark, sf):
    v = table(spark, sf, "vertices")
    metres = v.select("plan_id", "room_ix", "vix", ((F.col("ix") + (F.col("vix") % 5 - 2) * 0.2) * K.STEP_M).alias("x"), (F.col("iy") * K.STEP_M).alias("y"))
    return metres.select("plan_id", "room_ix", "vix", M.quantise(F.col("x")).alias("qx"), M.quantise(F.col("y")).alias("qy"))


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, area2 FROM r")
def c03_signed_area(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", "area2")


@register(f"WITH {B} SELECT plan_id, room_ix, vix, ix, iy FROM vertices")
def c04_orient_ccw(spark, sf):
    v = table(spark, sf, "vertices")
    n = F.count(F.lit(1)).over(M.Window.partitionBy("plan_id", "room_ix"))
    mixed = v.withColumn("vix", F.when(F.col("room_ix") % 2 == 1, n - 1 - F.col("vix")).otherwise(F.col("vix")).cast("int"))
    return M.oriented(mixed).select("plan_id", "room_ix", "vix", "ix", "iy")


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, {q6('area_m2')}, {q6('perimeter_m')} FROM r")
def c05_area_perimeter(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", r6("area_m2"), r6("perimeter_m"))


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, {q6('pp')} FROM r")
def c06_polsby_popper(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", r6("pp"))


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, {q6('short_m')}, {q6('long_m')} FROM r")
def c07_bounding_sides(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", r6("short_m"), r6("long_m"))


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, {q6('squareness')} FROM r")
def c08_squareness(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", r6("squareness"))


ANGLE_SQL = f"{B}, ang AS MATERIALIZED (SELECT plan_id, atan2(sum({LEN} * sin(4 * atan2(CAST(by_ - ay AS DOUBLE), CAST(bx - ax AS DOUBLE)))), sum({LEN} * cos(4 * atan2(CAST(by_ - ay AS DOUBLE), CAST(bx - ax AS DOUBLE))))) / 4 AS angle FROM edges GROUP BY plan_id)"


@register(f"WITH {ANGLE_SQL} SELECT plan_id, {q6('angle')} FROM ang")
def c09_dominant_direction(spark, sf):
    return M.dominant_direction(table(spark, sf, "edges")).select("plan_id", r6("angle"))


BOX_SQL = f"""{ANGLE_SQL}, uv AS (SELECT e.plan_id, room_ix, category, ax * cos(angle) + ay * sin(angle) AS u, ay * cos(angle) - ax * sin(angle) AS v FROM edges e JOIN ang ON ang.plan_id = e.plan_id),
box AS (SELECT plan_id, room_ix, category, least(max(u) - min(u), max(v) - min(v)) * {S} AS min_width_m, greatest(max(u) - min(u), max(v) - min(v)) * {S} AS long_m FROM uv GROUP BY plan_id, room_ix, category)"""


@register(f"WITH {BOX_SQL} SELECT plan_id, room_ix, {q6('min_width_m')}, {q6('long_m')} FROM box")
def c11_min_width(spark, sf):
    e = table(spark, sf, "edges")
    return M.rotated_boxes(e, M.dominant_direction(e)).select("plan_id", "room_ix", r6("min_width_m"), r6("long_m"))


@register(f"""WITH {B}, a AS (SELECT plan_id, {LEN} AS len, atan2(CAST(by_ - ay AS DOUBLE), CAST(bx - ax AS DOUBLE)) AS t FROM edges),
b AS (SELECT plan_id, len, t - floor(t / (pi() / 2)) * (pi() / 2) AS t FROM a)
SELECT plan_id, round(coalesce(sum(CASE WHEN least(t, pi() / 2 - t) > {math.radians(2.0)!r} THEN len END), 0) / sum(len) + 1e-9, 6) + 0.0 AS off_axis FROM b GROUP BY plan_id""")
def c12_off_axis_fraction(spark, sf):
    return M.off_axis_share(table(spark, sf, "edges")).select("plan_id", r6("off_axis"))


@register(f"""WITH {B} SELECT plan_id, room_ix, round(sum((ax + bx) * (ax * by_ - bx * ay)) / (3.0 * sum(ax * by_ - bx * ay)) * {S} + 1e-9, 6) + 0.0 AS cx_m, round(sum((ay + by_) * (ax * by_ - bx * ay)) / (3.0 * sum(ax * by_ - bx * ay)) * {S} + 1e-9, 6) + 0.0 AS cy_m FROM edges GROUP BY plan_id, room_ix""")
def c13_centroid(spark, sf):
    return M.centroids(table(spark, sf, "edges")).select("plan_id", "room_ix", r6("cx_m"), r6("cy_m"))


@register(f"""WITH {B}, d AS (SELECT p.plan_id, p.room_ix, p.eix, q.eix AS e2, q.ax - p.ax AS dx, q.ay - p.ay AS dy FROM edges p JOIN edges q ON p.plan_id = q.plan_id AND p.room_ix = q.room_ix AND p.eix < q.eix WHERE q.ax <> p.ax OR q.ay <> p.ay),
b AS (SELECT d.plan_id, d.room_ix, (max(v.ax * dx + v.ay * dy) - min(v.ax * dx + v.ay * dy)) * CAST(max(v.ay * dx - v.ax * dy) - min(v.ay * dx - v.ax * dy) AS DOUBLE) / any_value(dx * dx + dy * dy) AS box FROM d JOIN edges v ON v.plan_id = d.plan_id AND v.room_ix = d.room_ix GROUP BY d.plan_id, d.room_ix, d.eix, d.e2),
a AS (SELECT plan_id, room_ix, abs(sum(ax * by_ - bx * ay)) / 2.0 AS area FROM edges GROUP BY plan_id, room_ix)
SELECT a.plan_id, a.room_ix, round(any_value(area) / min(box) + 1e-9, 6) + 0.0 AS rect FROM a JOIN b ON a.plan_id = b.plan_id AND a.room_ix = b.room_ix GROUP BY a.plan_id, a.room_ix""")
def c14_rectangularity(spark, sf):
    return M.rectangularity(table(spark, sf, "edges")).select("plan_id", "room_ix", r6("rect"))


@register(f"WITH {B} SELECT plan_id, room_ix, eix, ax, ay, bx, by_ FROM edges")
def c15_segments(spark, sf):
    return M.edges_of(table(spark, sf, "vertices")).select("plan_id", "room_ix", "eix", "ax", "ay", "bx", "by_")


@register(f"""WITH {ANGLE_SQL}, c AS MATERIALIZED (SELECT plan_id, sum((ax + bx) * (ax * by_ - bx * ay)) / (3.0 * sum(ax * by_ - bx * ay)) AS cx, sum((ay + by_) * (ax * by_ - bx * ay)) / (3.0 * sum(ax * by_ - bx * ay)) AS cy FROM edges WHERE room_ix = 0 GROUP BY plan_id)
SELECT v.plan_id, room_ix, vix, round((cx + (ix - cx) * cos(angle) + (iy - cy) * sin(angle)) * {S} + 1e-9, 6) + 0.0 AS x_m, round((cy + (iy - cy) * cos(angle) - (ix - cx) * sin(angle)) * {S} + 1e-9, 6) + 0.0 AS y_m
FROM vertices v JOIN ang ON ang.plan_id = v.plan_id JOIN c ON c.plan_id = v.plan_id""")
def c16_align(spark, sf):
    """Every floor turned to its own axes about its first room's centroid (C10 is the rotation)."""
    e, v = table(spark, sf, "edges"), table(spark, sf, "vertices")
    about = M.centroids(e.where("room_ix = 0")).select("plan_id", (F.col("cx_m") / K.STEP_M).alias("cx"), (F.col("cy_m") / K.STEP_M).alias("cy"))
    j = v.join(M.dominant_direction(e), "plan_id").join(about, "plan_id")
    u, w = F.col("ix") - F.col("cx"), F.col("iy") - F.col("cy")
    x, y = F.col("cx") + u * F.cos("angle") + w * F.sin("angle"), F.col("cy") + w * F.cos("angle") - u * F.sin("angle")
    return j.select("plan_id", "room_ix", "vix", (F.round(x * K.STEP_M + 1e-9, 6) + 0.0).alias("x_m"), (F.round(y * K.STEP_M + 1e-9, 6) + 0.0).alias("y_m"))


# ---- D: cross-room geometry ----------------------------------------------------------------------------------------------


@register(f"""WITH {B}, n AS (SELECT plan_id, room_ix, vix, ix, iy, count(*) OVER w AS k, coalesce(lag(ix) OVER o, last_value(ix) OVER f) AS px, coalesce(lag(iy) OVER o, last_value(iy) OVER f) AS py, coalesce(lead(ix) OVER o, first_value(ix) OVER f) AS nx, coalesce(lead(iy) OVER o, first_value(iy) OVER f) AS ny FROM vertices
  WINDOW w AS (PARTITION BY plan_id, room_ix), o AS (PARTITION BY plan_id, room_ix ORDER BY vix), f AS (PARTITION BY plan_id, room_ix ORDER BY vix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, bool_and(k >= 3 AND (ix - px) * (ny - iy) = (iy - py) * (nx - ix)) OVER (PARTITION BY plan_id, ix, iy) AS gone FROM n),
e AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id, room_ix) AS rest FROM d)
SELECT plan_id, room_ix, CAST(row_number() OVER (PARTITION BY plan_id, room_ix ORDER BY vix) - 1 AS INTEGER) AS vix, ix, iy FROM e WHERE NOT gone OR rest < 3""")
def d01_drop_collinear(spark, sf):
    return M.without_collinear(table(spark, sf, "vertices")).select("plan_id", "room_ix", "vix", "ix", "iy")


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, n >= 3 AND area2 <> 0 AS valid FROM r")
def d02_ring_validity(spark, sf):
    facts = L.room_facts(staged_edges(spark, sf)[0])
    return facts.select("plan_id", "room_ix", ((F.col("n") >= 3) & (F.col("area2") != 0) & F.col("crossed").isNull()).alias("valid"))


COVER_SQL = f"""{B},
x AS (SELECT p.plan_id, p.ax + CAST((p.bx - p.ax) * ((q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) AS DOUBLE) / ((p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax)) AS x,
    (p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax) AS d, (q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax) AS t, (q.ax - p.ax) * (p.by_ - p.ay) - (q.ay - p.ay) * (p.bx - p.ax) AS u
  FROM edges p JOIN edges q ON p.plan_id = q.plan_id AND p.room_ix < q.room_ix AND (p.bx - p.ax) * (q.by_ - q.ay) <> (p.by_ - p.ay) * (q.bx - q.ax)),
marks AS (SELECT DISTINCT plan_id, x FROM (SELECT plan_id, CAST(ax AS DOUBLE) AS x FROM edges UNION ALL SELECT plan_id, x FROM x WHERE sign(t) = sign(d) AND abs(t) < abs(d) AND sign(u) = sign(d) AND abs(u) < abs(d))),
slabs AS (SELECT * FROM (SELECT plan_id, x AS x0, lead(x) OVER (PARTITION BY plan_id ORDER BY x) AS x1 FROM marks) WHERE x1 IS NOT NULL),
act AS (SELECT s.plan_id, x0, x1, room_ix, eix, ay + (by_ - ay) * ((x0 + x1) / 2 - ax) / (bx - ax) AS y, sign(bx - ax) AS up FROM slabs s JOIN edges e ON e.plan_id = s.plan_id AND ax <> bx AND least(ax, bx) <= x0 AND greatest(ax, bx) >= x1),
dep AS (SELECT plan_id, x1 - x0 AS dx, y, sum(up) OVER (w ROWS UNBOUNDED PRECEDING) AS depth, lead(y) OVER w AS y1 FROM act WINDOW w AS (PARTITION BY plan_id, x0 ORDER BY y, up DESC, room_ix, eix)),
cov AS (SELECT plan_id, sum(dx * (y1 - y) * depth) AS rooms2, sum(CASE WHEN depth > 0 THEN dx * (y1 - y) ELSE 0 END) AS union2, sum(CASE WHEN depth > 1 THEN dx * (y1 - y) * (depth - 1) ELSE 0 END) AS twice2 FROM dep WHERE y1 IS NOT NULL GROUP BY plan_id)"""


@register(f"WITH {COVER_SQL} SELECT plan_id, {q6('rooms2')}, {q6('union2')} FROM cov")
def d05_union_by_slabs(spark, sf):
    return V.cover(table(spark, sf, "edges")).select("plan_id", r6("rooms2"), r6("union2"))


@register(f"WITH {COVER_SQL} SELECT plan_id, {q6('twice2')}, twice2 / union2 > {K.OVERLAP_SHARE} AS claimed_twice FROM cov")
def d04_twice_claimed(spark, sf):
    c = V.cover(table(spark, sf, "edges"))
    return c.select("plan_id", r6("twice2"), (F.col("twice2") / F.col("union2") > K.OVERLAP_SHARE).alias("claimed_twice"))


LINED_SQL = f"""{B}, ln AS (SELECT plan_id, room_ix, bx = ax AS up, CASE WHEN bx = ax THEN 0.0 ELSE CAST(by_ - ay AS DOUBLE) / (bx - ax) + 0.0 END AS slope,
  CASE WHEN bx = ax THEN CAST(ax AS DOUBLE) ELSE CAST(ay * (bx - ax) - ax * (by_ - ay) AS DOUBLE) / (bx - ax) + 0.0 END AS off0, CASE WHEN bx = ax THEN least(ay, by_) ELSE least(ax, bx) END AS lo, CASE WHEN bx = ax THEN greatest(ay, by_) ELSE greatest(ax, bx) END AS hi FROM edges),
walls AS (SELECT p.plan_id, p.room_ix AS a, q.room_ix AS b, sum((least(p.hi, q.hi) - greatest(p.lo, q.lo)) * CASE WHEN p.up THEN 1.0 ELSE sqrt(1 + p.slope * p.slope) END) * {S} AS run_m
  FROM ln p JOIN ln q ON p.plan_id = q.plan_id AND p.up = q.up AND p.slope = q.slope AND p.off0 = q.off0 AND p.room_ix < q.room_ix AND least(p.hi, q.hi) > greatest(p.lo, q.lo) GROUP BY p.plan_id, p.room_ix, q.room_ix)"""


@register(f"WITH {LINED_SQL} SELECT plan_id, a, b, {q6('run_m')}, CAST(row_number() OVER (PARTITION BY plan_id, b ORDER BY round(run_m, 9) DESC, a) AS INTEGER) AS place FROM walls")
def d11_bounding_rooms(spark, sf):
    """For each room the lower rooms it touches, the longest shared wall first."""
    w = V.Window.partitionBy("plan_id", "b").orderBy(F.desc(F.round("run_m", 9)), "a")
    return V.shared_walls(table(spark, sf, "edges")).select("plan_id", "a", "b", r6("run_m"), F.row_number().over(w).alias("place"))


SPANS_SQL = """x AS (SELECT p.plan_id, p.ax + CAST((p.bx - p.ax) * ((q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) AS DOUBLE) / ((p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax)) AS x,
    (p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax) AS d, (q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax) AS t, (q.ax - p.ax) * (p.by_ - p.ay) - (q.ay - p.ay) * (p.bx - p.ax) AS u
  FROM EDGES p JOIN EDGES q ON p.plan_id = q.plan_id AND p.room_ix < q.room_ix AND (p.bx - p.ax) * (q.by_ - q.ay) <> (p.by_ - p.ay) * (q.bx - q.ax)),
marks AS (SELECT DISTINCT plan_id, x FROM (SELECT plan_id, CAST(ax AS DOUBLE) AS x FROM EDGES UNION ALL SELECT plan_id, x FROM x WHERE sign(t) = sign(d) AND abs(t) < abs(d) AND sign(u) = sign(d) AND abs(u) < abs(d))),
slabs AS (SELECT * FROM (SELECT plan_id, x AS x0, lead(x) OVER (PARTITION BY plan_id ORDER BY x) AS x1 FROM marks) WHERE x1 IS NOT NULL),
act AS (SELECT s.plan_id, x0, x1, room_ix, eix, ay + (by_ - ay) * ((x0 + x1) / 2 - ax) / (bx - ax) AS lo FROM slabs s JOIN EDGES e ON e.plan_id = s.plan_id AND ax <> bx AND least(ax, bx) <= x0 AND greatest(ax, bx) >= x1),
spans AS (SELECT * FROM (SELECT plan_id, x0, x1, room_ix, lo, lead(lo) OVER w AS hi, row_number() OVER w AS k FROM act WINDOW w AS (PARTITION BY plan_id, room_ix, x0 ORDER BY lo, eix)) WHERE k % 2 = 1 AND hi > lo),
olap AS (SELECT p.plan_id, p.room_ix AS a, q.room_ix AS b, sum((least(p.hi, q.hi) - greatest(p.lo, q.lo)) * (p.x1 - p.x0)) AS area2 FROM spans p JOIN spans q ON p.plan_id = q.plan_id AND p.x0 = q.x0 AND p.room_ix < q.room_ix AND least(p.hi, q.hi) - greatest(p.lo, q.lo) > 1e-9 GROUP BY p.plan_id, p.room_ix, q.room_ix)"""
PARTS_SQL = f"""{LINED_SQL}, {SPANS_SQL.replace('EDGES', 'edges')}, touch AS (SELECT plan_id, a, b FROM walls UNION SELECT plan_id, a, b FROM olap),
rms AS (SELECT DISTINCT plan_id, room_ix FROM edges), starts AS (SELECT plan_id, room_ix, CASE WHEN EXISTS (SELECT 1 FROM touch t WHERE t.plan_id = b.plan_id AND t.b = b.room_ix) THEN 0 ELSE 1 END AS s FROM rms b),
prt AS (SELECT plan_id, room_ix, sum(s) OVER (PARTITION BY plan_id ORDER BY room_ix) AS k FROM starts)"""


@register(f"WITH {PARTS_SQL} SELECT plan_id, room_ix, min(room_ix) OVER (PARTITION BY plan_id, k) AS part FROM prt")
def d06_parts(spark, sf):
    edges, n = staged_edges(spark, sf)
    return V.parts(edges.select(*M.ROOM).distinct(), edges, V.staged_spans(edges, n)[1]).select("plan_id", "room_ix", "part")


_M = [f"{c} * {S} AS {n}" for c, n in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by_", '"by"'))]
_N = [f"{c} * {S} AS {n}" for c, n in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by_", "dy"))]
_face = lambda t: re.sub(r"\bby\b", '"by"', t)
FACING_SQL = f"""{B}, f0 AS MATERIALIZED (SELECT plan_id, room_ix AS a, {', '.join(_M)} FROM edges WHERE {LEN} * {S} >= 0.3), f1 AS MATERIALIZED (SELECT plan_id, room_ix AS b, {', '.join(_N)} FROM edges WHERE {LEN} * {S} >= 0.3),
fq AS (SELECT f0.plan_id, a, b, {', '.join(f'{_face(e)} AS {n}' for n, e in V.FACE.items())} FROM f0 JOIN f1 ON f0.plan_id = f1.plan_id AND a < b WHERE {_face(V.NEAR.format(r=0.5))}),
fp AS (SELECT * FROM fq WHERE cosine >= {math.cos(math.radians(5.0))!r} AND run_m >= 0.3 - 1e-9 AND gap_m <= 0.5 + 1e-9)"""


@register(f"WITH {FACING_SQL} SELECT plan_id, a, b, {q6('gap_m')}, {q6('run_m')} FROM fp")
def d18_facing_pairs(spark, sf):
    return V.facing_pairs(table(spark, sf, "edges")).select("plan_id", "a", "b", r6("gap_m"), r6("run_m"))


@register(f"""WITH {FACING_SQL}, g AS (SELECT plan_id, gap_m, sum(run_m) AS run FROM fp GROUP BY plan_id, gap_m), u AS (SELECT plan_id, gap_m, sum(run) OVER (PARTITION BY plan_id ORDER BY gap_m) AS upto, sum(run) OVER (PARTITION BY plan_id) AS total FROM g),
q AS (SELECT plan_id, min(gap_m) FILTER (upto >= 0.25 * total - 1e-9) AS q25, min(gap_m) FILTER (upto >= 0.5 * total - 1e-9) AS q50, min(gap_m) FILTER (upto >= 0.75 * total - 1e-9) AS q75 FROM u GROUP BY plan_id)
SELECT p.plan_id, round(coalesce(q25, 0.16) + 1e-9, 6) + 0.0 AS q25, round(coalesce(q50, 0.16) + 1e-9, 6) + 0.0 AS q50, round(coalesce(q75, 0.16) + 1e-9, 6) + 0.0 AS q75 FROM plans p LEFT JOIN q ON q.plan_id = p.plan_id""")
def d19_wall_gap(spark, sf):
    return V.wall_gaps(V.facing_pairs(table(spark, sf, "edges")), table(spark, sf, "plans")).select("plan_id", r6("q25"), r6("q50"), r6("q75"))


@register(f"""WITH {B}, c AS (SELECT plan_id, room_ix, CASE WHEN ax < bx OR (ax = bx AND ay <= by_) THEN [ax, ay, bx, by_] ELSE [bx, by_, ax, ay] END AS e FROM edges), k AS (SELECT plan_id, e, count(DISTINCT room_ix) AS n FROM c GROUP BY plan_id, e) SELECT plan_id, count(*) FILTER (n > 2) AS n FROM k GROUP BY plan_id""")
def d20_edges_over_two(spark, sf):
    return V.edges_over_two(table(spark, sf, "edges"))


@register(f"""WITH {LINED_SQL}, t AS (SELECT plan_id, sum({LEN}) * {S} AS all_m FROM edges GROUP BY plan_id), w AS (SELECT plan_id, sum(run_m) AS run_m FROM walls GROUP BY plan_id) SELECT t.plan_id, round(least(1.0, 2 * coalesce(run_m, 0) / all_m) + 1e-9, 6) + 0.0 AS share FROM t LEFT JOIN w ON w.plan_id = t.plan_id""")
def d21_shared_exact(spark, sf):
    return V.shared_share(table(spark, sf, "edges")).select("plan_id", r6("share"))


@register(f"""WITH {B}, e AS (SELECT plan_id, room_ix, ax, ay, bx, by_ FROM edges WHERE ax <> bx),
col AS (SELECT *, unnest(generate_series(CAST(ceil(least(ax, bx) / 11.0 - 0.5) AS BIGINT), CAST(ceil(greatest(ax, bx) / 11.0 - 0.5) - 1 AS BIGINT))) AS cx FROM e),
y AS (SELECT plan_id, room_ix, cx, ay + (by_ - ay) * ((cx + 0.5) * 11 - ax) / (bx - ax) AS y FROM col),
s AS (SELECT *, lead(y) OVER w AS y1, row_number() OVER w AS k FROM y WINDOW w AS (PARTITION BY plan_id, room_ix, cx ORDER BY y)),
z AS (SELECT plan_id, room_ix, cx, unnest(generate_series(CAST(ceil(y / 11.0 - 0.5) AS BIGINT), CAST(ceil(y1 / 11.0 - 0.5) - 1 AS BIGINT))) AS cy FROM s WHERE k % 2 = 1 AND y1 IS NOT NULL),
lowest AS (SELECT plan_id, cx, cy, min(room_ix) AS room_ix FROM z GROUP BY plan_id, cx, cy) SELECT plan_id, room_ix, count(*) AS cells FROM lowest GROUP BY plan_id, room_ix""")
def d23_raster_cells(spark, sf):
    """Cells of 11 steps (about 0.38 m) by room."""
    return V.raster(table(spark, sf, "edges"), 11).groupBy("plan_id", "room_ix").agg(F.count(F.lit(1)).alias("cells"))


@register(f"WITH {ROOMS_SQL} SELECT plan_id, room_ix, area_m2 < 0.05 OR 2 * area_m2 / perimeter_m < 0.05 AS sliver FROM r")
def d29_sliver(spark, sf):
    return _rooms(spark, sf).select("plan_id", "room_ix", ((F.col("area_m2") < 0.05) | (2 * F.col("area_m2") / F.col("perimeter_m") < 0.05)).alias("sliver"))


@register(f"WITH {B} SELECT plan_id, room_ix, eix, least(abs(bx - ax), abs(by_ - ay)) * {S} <= 0.02 AS on_axis FROM edges")
def d32_on_axis(spark, sf):
    return table(spark, sf, "edges").select("plan_id", "room_ix", "eix", (F.least(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by_") - F.col("ay"))) * K.STEP_M <= 0.02).alias("on_axis"))


# ---- E: the ladder -------------------------------------------------------------------------------------------------------


@register(f"WITH {LADDER_SQL}, x AS (SELECT plan_id, arg_min(room_ix, (score, room_ix)) AS room FROM f WHERE tag <> 'Hallway' GROUP BY plan_id) SELECT graded.plan_id, {q6('score')}, x.room, f2 AS rejected FROM graded LEFT JOIN x ON x.plan_id = graded.plan_id")
def e02_room_compactness(spark, sf):
    return _graded(spark, sf).select("plan_id", r6("compact.score", "score"), F.col("compact.room_ix").alias("room"), F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False)).alias("rejected"))


@register(f"WITH {LADDER_SQL} SELECT plan_id, {q6('margin')}, f3 AS rejected FROM graded")
def e03_room_proportions(spark, sf):
    return _graded(spark, sf).select("plan_id", r6("proportion.margin", "margin"), F.coalesce(F.col("proportion.margin") < -K.ABS_TOL_M, F.lit(False)).alias("rejected"))


@register(f"WITH {LADDER_SQL} SELECT plan_id, min(room_ix) AS room FROM f WHERE off_axis GROUP BY plan_id")
def e04_room_appendices(spark, sf):
    return _graded(spark, sf).where("appendix IS NOT NULL").select("plan_id", F.col("appendix.room_ix").alias("room"))


@register(f"WITH {LADDER_SQL} SELECT plan_id, grp, stopped_at, not_run, passed FROM graded")
def e06_ladder(spark, sf):
    return _graded(spark, sf).select("plan_id", "grp", "stopped_at", "not_run", "passed")


@register(f"""WITH {LADDER_SQL}, s AS (SELECT plan_id, unnest([1, 2, 3, 4, 5, 6]) AS number, f2, f3, f4, CASE WHEN f2 THEN 2 WHEN f3 THEN 3 WHEN f4 THEN 4 ELSE 10 END AS stop FROM graded)
SELECT plan_id, number, CASE WHEN number > stop THEN 'not reached' WHEN number = 1 THEN 'passed' WHEN number = 2 THEN CASE WHEN f2 THEN 'rejected' ELSE 'passed' END WHEN number = 3 THEN CASE WHEN f3 THEN 'rejected' ELSE 'passed' END WHEN number = 4 AND f4 THEN 'not run' ELSE 'not transferable' END AS verdict FROM s""")
def e05_rung_rows(spark, sf):
    return _graded(spark, sf).select("plan_id", F.explode("rungs").alias("r")).select("plan_id", "r.number", "r.verdict")


@register(f"WITH {LADDER_SQL} SELECT plan_id, CASE WHEN f2 THEN 'roomCompactness' END AS stopped_at, CASE WHEN NOT f2 AND f4 THEN 'roomAppendices' END AS not_run, CASE WHEN f2 THEN FALSE WHEN f4 THEN NULL ELSE TRUE END AS passed FROM graded")
def e07_suppress_proportions(spark, sf):
    return _graded(spark, sf, ("roomProportions",)).select("plan_id", "stopped_at", "not_run", "passed")


@register(f"""WITH {BOX_SQL}, need AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {w})" for t, _, w in K.STANDARDS if w > 0)}) AS x(tag, required)), t AS (SELECT *, {D.tag_sql()} AS tag FROM box)
SELECT plan_id, room_ix, t.tag, {q6('min_width_m')}, CAST(required AS DOUBLE) AS required, min_width_m >= required - 0.001 AS met FROM t JOIN need ON need.tag = t.tag""")
def e08_width_observations(spark, sf):
    e = table(spark, sf, "edges")
    return L.width_observations(M.rotated_boxes(e, M.dominant_direction(e)), D.standards(spark)).select("plan_id", "room_ix", "tag", r6("min_width_m"), "required", "met")


@register(f"WITH {LADDER_SQL} SELECT plan_id, grp, CASE WHEN not_run IS NOT NULL THEN 'no verdict: ' || not_run || ' not run' WHEN stopped_at IS NOT NULL THEN 'stopped at ' || stopped_at ELSE 'passed' END AS verdict FROM graded")
def e09_verdict_text(spark, sf):
    return L.verdict_text(_graded(spark, sf))


@register()
def e10_reports(spark, sf):
    return L.reports(_graded(spark, sf))


@register(f"WITH {LADDER_SQL}, c AS (SELECT grp, count(*) AS graded, count(*) FILTER (NOT f2) AS passed FROM graded GROUP BY grp) SELECT grp, graded, passed, round(rate + 1e-9, 6) AS rate, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high FROM (SELECT *, {wilson_sql('passed', 'graded')} FROM c)")
def m1_rung2_pass_rates(spark, sf):
    """Pass rate of the compactness check alone by group, with its interval."""
    g = L.rung_inputs(table(spark, sf, "plans"), M.room_measures(table(spark, sf, "edges")).withColumns({"off_m": F.lit(None).cast("double"), "crossed": F.lit(None).cast("long")}), D.floors(spark))
    c = g.groupBy("grp").agg(F.count(F.lit(1)).alias("graded"), F.count_if(~F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False))).alias("passed"))
    return O.with_wilson(c, "passed", "graded").select("grp", "graded", "passed", r6("rate"), r6("low"), r6("high"))


# ---- F: access graph, apartments, exposure -------------------------------------------------------------------------------

UNITS_SQL = f"""{B}, roots AS (SELECT plan_id, room_ix, category, min(room_ix) OVER (PARTITION BY plan_id, flat) AS root FROM rooms),
live AS (SELECT plan_id, root FROM roots GROUP BY plan_id, root HAVING bool_or(category = 'bathroom') AND bool_or(category IN ('livingroom', 'bedroom', 'diningroom', 'masterroom', 'living_room', 'dining'))),
num AS (SELECT plan_id, root, CAST(dense_rank() OVER (PARTITION BY plan_id ORDER BY root) - 1 AS INTEGER) AS unit_ix FROM live),
mem AS (SELECT r.plan_id, r.room_ix, r.category, r.root, n.unit_ix FROM roots r LEFT JOIN num n ON n.plan_id = r.plan_id AND n.root = r.root)"""


def _members(spark, sf, access=None, n=None):
    """Rooms with their apartment, from rooms written once in n buckets of plan_id; access, if given, in as many."""
    n = bridge.parts(spark, sf) if n is None else n
    rooms = stage_by(table(spark, sf, "rooms", n).select("plan_id", "room_ix", "category"), "plan_id", "rooms", n)
    return G.apartments(rooms, G.room_components(rooms, table(spark, sf, "access", n) if access is None else access))


@register(f"WITH {UNITS_SQL} SELECT plan_id, room_ix, root FROM roots")
def f01_components(spark, sf):
    return G.room_components(table(spark, sf, "rooms"), table(spark, sf, "access")).select("plan_id", "room_ix", "root")


@register(f"WITH {UNITS_SQL} SELECT plan_id, room_ix, unit_ix FROM mem")
def f03_apartments(spark, sf):
    return _members(spark, sf).select("plan_id", "room_ix", "unit_ix")


@register(f"""WITH {UNITS_SQL}, s AS (SELECT plan_id, edge_ix, 0 AS side, a AS room_ix, b AS t FROM access WHERE kind = 'entrance' UNION ALL SELECT plan_id, edge_ix, 1, b, a FROM access WHERE kind = 'entrance')
SELECT s.plan_id, m.unit_ix, arg_min(s.room_ix, s.edge_ix * 2 + side) AS entry_room FROM s JOIN mem m ON m.plan_id = s.plan_id AND m.room_ix = s.room_ix JOIN mem o ON o.plan_id = s.plan_id AND o.room_ix = s.t WHERE m.unit_ix IS NOT NULL AND (o.unit_ix IS NULL OR o.unit_ix <> m.unit_ix) GROUP BY s.plan_id, m.unit_ix""")
def f04_entry_rooms(spark, sf):
    n = bridge.parts(spark, sf)
    access = stage_by(table(spark, sf, "access", n), "plan_id", "access", n)
    return G.entry_rooms(stage_by(_members(spark, sf, access, n), "plan_id", "members", n), access)


@register(f"WITH {UNITS_SQL} SELECT plan_id, count(DISTINCT unit_ix) AS units, greatest(count(DISTINCT unit_ix), 1) AS at_least_one FROM mem GROUP BY plan_id")
def f05_unit_counts(spark, sf):
    """Apartments by plan, as they are and one at least (B9)."""
    n = G.unit_labels(_members(spark, sf)).groupBy("plan_id").agg(F.countDistinct("unit").alias("units"))
    return n.select("plan_id", "units", F.greatest("units", F.lit(1)).alias("at_least_one"))


@register(f"""WITH {UNITS_SQL}, loc AS (SELECT plan_id, unit_ix, room_ix, CAST(row_number() OVER (PARTITION BY plan_id, unit_ix ORDER BY room_ix) - 1 AS INTEGER) AS local_ix FROM mem WHERE unit_ix IS NOT NULL)
SELECT a.plan_id, a.unit_ix, a.local_ix AS la, b.local_ix AS lb, x.kind FROM access x JOIN loc a ON a.plan_id = x.plan_id AND a.room_ix = x.a JOIN loc b ON b.plan_id = x.plan_id AND b.room_ix = x.b AND b.unit_ix = a.unit_ix""")
def f06_unit_views(spark, sf):
    return G.unit_views(_members(spark, sf), table(spark, sf, "access"))[1]


@register(f"WITH {UNITS_SQL} SELECT n.plan_id, n.unit_ix, m.room_ix, CASE WHEN m.unit_ix IS NULL THEN -2 ELSE -3 END AS code FROM num n JOIN mem m ON m.plan_id = n.plan_id AND (m.unit_ix IS NULL OR m.unit_ix <> n.unit_ix)")
def f07_exposure_context(spark, sf):
    return G.exposure_context(_members(spark, sf))


@register(f"""WITH {UNITS_SQL}, {LINED_SQL[len(B) + 1:]}, sw AS (SELECT plan_id, a AS room_ix, b AS o, run_m FROM walls UNION ALL SELECT plan_id, b, a, run_m FROM walls),
oc AS (SELECT m.plan_id, m.unit_ix, CASE WHEN q.unit_ix IS NULL THEN 'corridor' WHEN q.unit_ix <> m.unit_ix THEN 'demising' WHEN q.category IN ('corridor', 'stairs') THEN 'hallway' ELSE 'interior' END AS class, run_m FROM mem m JOIN sw ON sw.plan_id = m.plan_id AND sw.room_ix = m.room_ix JOIN mem q ON q.plan_id = sw.plan_id AND q.room_ix = sw.o WHERE m.unit_ix IS NOT NULL),
pm AS (SELECT plan_id, room_ix, sum({LEN}) * {S} AS per FROM edges GROUP BY plan_id, room_ix), sh AS (SELECT plan_id, room_ix, sum(run_m) AS run FROM sw GROUP BY plan_id, room_ix),
ex AS (SELECT m.plan_id, m.unit_ix, 'exterior' AS class, pm.per - coalesce(sh.run, 0) AS run_m FROM mem m JOIN pm ON pm.plan_id = m.plan_id AND pm.room_ix = m.room_ix LEFT JOIN sh ON sh.plan_id = m.plan_id AND sh.room_ix = m.room_ix WHERE m.unit_ix IS NOT NULL),
w AS (SELECT * FROM oc UNION ALL SELECT * FROM ex), k AS (SELECT * FROM (SELECT DISTINCT plan_id FROM w), (VALUES ('exterior'), ('corridor'), ('demising'), ('hallway'), ('interior')) AS x(class))
SELECT k.plan_id, k.class, count(w.class) AS segments, round(coalesce(sum(run_m), 0.0) + 1e-9, 6) + 0.0 AS length_m FROM k LEFT JOIN w ON w.plan_id = k.plan_id AND w.class = k.class GROUP BY k.plan_id, k.class""")
def f09_exposure_histogram(spark, sf):
    """Wall length of the rooms of apartments by exposure class: shared walls by what is across them, the rest of the outline as exterior."""
    e, parts = staged_edges(spark, sf)
    m = stage_by(_members(spark, sf), "plan_id", "members", parts)
    own = m.where("unit_ix IS NOT NULL").select("plan_id", "room_ix", "unit_ix")
    runs = V.shared_walls(e)
    sides = stage_by(runs.select("plan_id", F.col("a").alias("room_ix"), F.col("b").alias("other"), "run_m").union(runs.select("plan_id", "b", "a", "run_m")), "plan_id", "sides", parts)
    across = m.select("plan_id", F.col("room_ix").alias("other"), F.col("unit_ix").alias("its"), F.col("category").isin(*G.CIRCULATION).alias("circulating"))
    owner = F.when(F.col("its") == F.col("unit_ix"), F.col("other")).when(F.col("its").isNull(), K.EXPOSURE["corridor"]).otherwise(K.EXPOSURE["demising"])
    met = own.join(sides, ["plan_id", "room_ix"]).join(across, ["plan_id", "other"]).select("plan_id", G.code_of(G.encode(owner, F.col("circulating"))).alias("code"), F.col("run_m").alias("length_m"))
    shared = sides.groupBy("plan_id", "room_ix").agg(F.sum("run_m").alias("run"))
    rest = M.room_measures(e).select("plan_id", "room_ix", "perimeter_m").join(own, ["plan_id", "room_ix"]).join(shared, ["plan_id", "room_ix"], "left")
    rest = rest.select("plan_id", F.lit(K.EXPOSURE["exterior"]).alias("code"), (F.col("perimeter_m") - F.coalesce("run", F.lit(0.0))).alias("length_m"))
    name = F.coalesce(*[F.when(F.col("code") == v, n) for n, v in K.EXPOSURE.items()], F.lit("interior")).alias("class")
    return G.exposure_histogram(met.unionByName(rest).select("plan_id", name, "length_m")).select("plan_id", "class", "segments", r6("length_m"))


# ---- G: outcomes, intervals, bootstraps ----------------------------------------------------------------------------------


@register(f"WITH {LADDER_SQL} SELECT grp, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) AS admitted, count(*) FILTER (not_run IS NULL) AS verdict FROM graded GROUP BY grp")
def g01_outcomes(spark, sf):
    return O.outcomes(_graded(spark, sf))


@register(f"WITH {CELLS_SQL} SELECT grp, denominator, passed, total, round(rate + 1e-9, 6) AS rate, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high FROM (SELECT *, {wilson_sql('passed', 'total')} FROM rt WHERE total > 0)")
def g03_wilson_rates(spark, sf):
    return O.with_wilson(O.rates(O.outcomes(_events(spark, sf)))).where("total > 0").select("grp", "denominator", "passed", "total", r6("rate"), r6("low"), r6("high"))


MARGIN_SQL = f"""{CELLS_SQL}, {ROLES_SQL}, w AS (SELECT rt.*, role, {wilson_sql('passed', 'total')} FROM rt JOIN roles ON roles.grp = rt.grp WHERE total > 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY denominator ORDER BY rate, grp) AS k FROM w WHERE role = 'truth') WHERE k = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY denominator ORDER BY rate DESC, grp DESC) AS k FROM w WHERE role = 'baseline') WHERE k = 1),
mg AS (SELECT t.denominator, t.grp AS truth, b.grp AS baseline, t.rate - b.rate AS margin, t.rate - b.rate - sqrt((t.rate - t.low) * (t.rate - t.low) + (b.high - b.rate) * (b.high - b.rate)) AS low, t.rate - b.rate + sqrt((t.high - t.rate) * (t.high - t.rate) + (b.rate - b.low) * (b.rate - b.low)) AS high, t.low <= b.high AS rates_overlap FROM t JOIN b ON t.denominator = b.denominator)"""


@register(f"WITH {MARGIN_SQL} SELECT denominator, truth, baseline, {q6('margin')}, {q6('low')}, {q6('high')}, rates_overlap, low > 0 OR high < 0 AS excludes_zero FROM mg")
def g07_margins(spark, sf):
    m = O.margins(O.rates(O.outcomes(_events(spark, sf))), D.groups(spark))
    return m.select("denominator", "truth", "baseline", r6("margin"), r6("low"), r6("high"), "rates_overlap", "excludes_zero")


@register(f"""WITH {LADDER_SQL}, k AS (SELECT grp, coalesce(not_run || ' not run', stopped_at, 'passed') AS class FROM graded)
SELECT grp, count(*) FILTER (class = 'roomCompactness') AS "roomCompactness", count(*) FILTER (class = 'roomProportions') AS "roomProportions", count(*) FILTER (class = 'roomAppendices not run') AS "roomAppendices not run", count(*) FILTER (class = 'passed') AS passed, count(*) AS total FROM k GROUP BY grp""")
def g12_stop_profile(spark, sf):
    return O.profile(L.stop_class(_graded(spark, sf)), ["roomCompactness", "roomProportions", "roomAppendices not run", "passed"])


@register(f"WITH {CELLS_SQL} SELECT grp, missing, total, round(rate + 1e-9, 6) AS rate, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high FROM (SELECT grp, graded - verdict AS missing, graded AS total, {wilson_sql('(graded - verdict)', 'graded')} FROM c)")
def g13_no_verdict(spark, sf):
    return O.no_verdict(O.outcomes(_events(spark, sf))).select("grp", "missing", "total", r6("rate"), r6("low"), r6("high"))


@register(f"WITH {EVENT_SQL} SELECT grp, cluster, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) FILTER (admitted) AS admitted, count(*) FILTER (admitted AND not_run IS NULL) AS verdict FROM v GROUP BY grp, cluster")
def g16_cluster_totals(spark, sf):
    return O.cluster_totals(_events(spark, sf))


U = lambda *parts: "CAST(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8)) AS BIGINT) / 4294967296.0"
DRAWS, REPLICATES = K.DRAWS, K.REPLICATES
DRAW_SQL = f"""{CELLS_SQL}, {ROLES_SQL}, ins AS (SELECT grp, passed, graded AS total, passed / CAST(graded AS DOUBLE) AS r FROM c WHERE passed > 0 AND passed < graded),
rg AS (SELECT grp, total, r, greatest(0, passed - CAST(ceil({O.SPAN} * sqrt(total * r * (1 - r))) AS BIGINT) - {O.SPAN}) AS k0, least(total, passed + CAST(ceil({O.SPAN} * sqrt(total * r * (1 - r))) AS BIGINT) + {O.SPAN}) AS k1 FROM ins),
st AS (SELECT grp, total, r, k0, unnest(generate_series(k0, k1)) AS k FROM rg),
lp AS (SELECT grp, k, sum(CASE WHEN k = k0 THEN 0.0 ELSE ln((total - k + 1) / CAST(k AS DOUBLE)) + ln(r / (1 - r)) END) OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING) AS lp FROM st),
wt AS (SELECT grp, k, exp(lp - max(lp) OVER (PARTITION BY grp)) AS w FROM lp),
cdf AS (SELECT grp, k, sum(w) OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY grp) AS at_ FROM wt),
ask AS (SELECT grp, total, draw, {U(f"'{K.DRAW_SEED}'", 'grp', 'CAST(draw AS VARCHAR)')} AS u FROM (SELECT grp, total, unnest(generate_series(0, {DRAWS - 1})) AS draw FROM ins)),
dr AS (SELECT ask.grp, draw, coalesce(cdf.k, (SELECT k1 FROM rg WHERE rg.grp = ask.grp)) AS k FROM ask ASOF LEFT JOIN cdf ON ask.grp = cdf.grp AND ask.u <= cdf.at_)"""


@register(f"WITH {DRAW_SQL} SELECT grp, draw, k FROM dr UNION ALL SELECT grp, unnest(generate_series(0, {DRAWS - 1})), passed FROM c WHERE graded > 0 AND (passed = 0 OR passed = graded)")
def g09_binomial_draws(spark, sf):
    c = O.outcomes(_events(spark, sf)).select("grp", "passed", F.col("graded").alias("total"))
    return O.binomial_draws(c, DRAWS)


@register(f"""WITH {DRAW_SQL}, al AS (SELECT grp, draw, k FROM dr UNION ALL SELECT grp, unnest(generate_series(0, {DRAWS - 1})), passed FROM c WHERE graded > 0 AND (passed = 0 OR passed = graded)),
mg AS (SELECT draw, min(CASE WHEN role = 'truth' THEN 100 * k / CAST(graded AS DOUBLE) END) - max(CASE WHEN role = 'baseline' THEN 100 * k / CAST(graded AS DOUBLE) END) AS margin FROM al JOIN c ON c.grp = al.grp JOIN roles ON roles.grp = al.grp GROUP BY draw)
SELECT round(quantile_cont(margin, 0.025) + 1e-9, 6) AS low, round(quantile_cont(margin, 0.975) + 1e-9, 6) AS high FROM mg""")
def g10_bootstrap_margin(spark, sf):
    c = O.outcomes(_events(spark, sf)).select("grp", "passed", F.col("graded").alias("total"))
    return O.bootstrap_margin(c, D.groups(spark), DRAWS).select(r6("low"), r6("high"))


def resample_sql(*kept: str) -> str:
    """CTEs from t (grp, cluster, kept) to rp (replicate, grp, kept): Poisson numbers of each class of equal totals, then single clusters."""
    names, key, part = ", ".join(kept), " || '|' || ".join(kept), lambda h: f"CAST(('0x' || substr({h}, 8 * i + 1, 8)) AS BIGINT) / 4294967296.0"
    sums = lambda times: ", ".join(f"sum({times}{c}) AS {c}" for c in kept)
    return f"""cl AS (SELECT grp, {names}, count(*) AS n FROM t GROUP BY ALL), four AS (SELECT unnest([0, 1, 2, 3]) AS i),
sz AS (SELECT grp, c, greatest(0.0, 1 - {O.SPARE} / sqrt(c)) AS share FROM (SELECT grp, CAST(sum(n) AS BIGINT) AS c FROM cl GROUP BY grp)),
mean AS (SELECT DISTINCT cl.grp, n, share * n AS mean FROM cl JOIN sz ON sz.grp = cl.grp WHERE share > 0),
st AS (SELECT grp, n, mean, k0, unnest(generate_series(k0, k1)) AS k FROM (SELECT *, greatest(0, CAST(floor(mean) AS BIGINT) - CAST(ceil({O.SPAN} * sqrt(mean)) AS BIGINT) - {O.SPAN}) AS k0, CAST(floor(mean) AS BIGINT) + CAST(ceil({O.SPAN} * sqrt(mean)) AS BIGINT) + {O.SPAN} AS k1 FROM mean)),
lp AS (SELECT grp, n, k, sum(CASE WHEN k = k0 THEN 0.0 ELSE ln(mean / k) END) OVER (PARTITION BY grp, n ORDER BY k ROWS UNBOUNDED PRECEDING) AS lp FROM st),
wt AS (SELECT grp, n, k, exp(lp - max(lp) OVER (PARTITION BY grp, n)) AS w FROM lp),
cdf AS (SELECT grp, n, k, coalesce(sum(w) OVER (PARTITION BY grp, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(w) OVER (PARTITION BY grp, n) AS lo FROM wt),
q1 AS (SELECT *, md5('{K.REPLICATE_SEED}|first|' || grp || '|' || {key} || '|' || quad) AS h FROM (SELECT cl.*, unnest(generate_series(0, {(REPLICATES - 1) // 4})) AS quad FROM cl JOIN sz ON sz.grp = cl.grp WHERE share > 0)),
u1 AS (SELECT grp, n, {names}, quad * 4 + i AS replicate, {part('h')} AS u FROM q1, four WHERE quad * 4 + i < {REPLICATES}),
fd AS (SELECT u1.grp, replicate, CAST(sum(k) AS BIGINT) AS drawn, {sums('k * ')} FROM u1 ASOF JOIN cdf ON u1.grp = cdf.grp AND u1.n = cdf.n AND u1.u >= cdf.lo GROUP BY u1.grp, replicate),
sh AS (SELECT x.grp, x.replicate, c - coalesce(drawn, 0) AS r FROM (SELECT grp, c, unnest(generate_series(0, {REPLICATES - 1})) AS replicate FROM sz) x LEFT JOIN fd ON fd.grp = x.grp AND fd.replicate = x.replicate),
q2 AS (SELECT *, md5('{K.REPLICATE_SEED}|rest|' || grp || '|' || replicate || '|' || quad) AS h FROM (SELECT *, unnest(generate_series(0, (r - 1) // 4)) AS quad FROM sh WHERE r > 0)),
u2 AS (SELECT grp, replicate, {part('h')} AS u FROM q2, four WHERE quad * 4 + i < r),
iv AS (SELECT cl.*, (sum(n) OVER (PARTITION BY cl.grp ORDER BY {names}) - n) / CAST(c AS DOUBLE) AS lo FROM cl JOIN sz ON sz.grp = cl.grp),
rd AS (SELECT u2.grp, replicate, {sums('')} FROM u2 ASOF JOIN iv ON u2.grp = iv.grp AND u2.u >= iv.lo GROUP BY u2.grp, replicate),
rp AS (SELECT replicate, grp, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in kept)} FROM (SELECT grp, replicate, {names} FROM fd UNION ALL SELECT grp, replicate, {names} FROM rd) GROUP BY replicate, grp)"""


CLUSTER_SQL = f"""{EVENT_SQL}, {ROLES_SQL}, t AS (SELECT grp, cluster, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) FILTER (admitted) AS admitted, count(*) FILTER (admitted AND not_run IS NULL) AS verdict FROM v GROUP BY grp, cluster),
{resample_sql('graded', 'passed', 'admitted', 'verdict')}"""


@register(f"WITH {CLUSTER_SQL} SELECT CAST(replicate AS INTEGER) AS replicate, grp, graded, passed, admitted, verdict FROM rp")
def g17_cluster_replicates(spark, sf):
    return O.cluster_replicates(O.cluster_totals(_events(spark, sf)), REPLICATES)


@register(f"""WITH {CLUSTER_SQL}, x AS (SELECT replicate, 'graded' AS denominator, grp, 100 * passed / CAST(graded AS DOUBLE) AS rate FROM rp UNION ALL SELECT replicate, 'admitted', grp, 100 * passed / CAST(admitted AS DOUBLE) FROM rp WHERE admitted > 0 UNION ALL SELECT replicate, 'verdict', grp, 100 * passed / CAST(verdict AS DOUBLE) FROM rp WHERE verdict > 0),
mg AS (SELECT replicate, denominator, min(CASE WHEN role = 'truth' THEN rate END) - max(CASE WHEN role = 'baseline' THEN rate END) AS margin FROM x JOIN roles ON roles.grp = x.grp GROUP BY replicate, denominator)
SELECT denominator, round(quantile_cont(margin, 0.025) + 1e-9, 6) AS low, round(quantile_cont(margin, 0.975) + 1e-9, 6) AS high FROM mg GROUP BY denominator""")
def g19_cluster_intervals(spark, sf):
    rep = O.cluster_replicates(O.cluster_totals(_events(spark, sf)), REPLICATES)
    return O.interval(O.replicate_margins(rep, D.groups(spark)), "margin", "denominator").select("denominator", r6("low"), r6("high"))


@register(f"""WITH {ROOMS_SQL} SELECT corpus, tag, count(*) AS n, {', '.join(f'round(quantile_cont(area_m2, {p / 100}) + 1e-9, 6) AS area_p{p}' for p in (5, 25, 50, 75, 95))}, {', '.join(f'round(quantile_cont(short_m, {p / 100}) + 1e-9, 6) AS width_p{p}' for p in (5, 25, 50))}, {', '.join(f'round(quantile_cont(long_m / short_m, {p / 100}) + 1e-9, 6) AS aspect_p{p}' for p in (5, 25, 50, 75, 95))}
FROM r JOIN plans p ON p.plan_id = r.plan_id WHERE tag <> 'Unset' GROUP BY corpus, tag""")
def g23_category_statistics(spark, sf):
    rooms = _rooms(spark, sf).where("tag <> 'Unset'").join(table(spark, sf, "plans").select("plan_id", "corpus"), "plan_id")
    s = O.category_statistics(rooms, "corpus")
    return s.select("corpus", "tag", "n", *[r6(c) for c in s.columns if "_p" in c])


# ---- H: similarity of floors ---------------------------------------------------------------------------------------------

CELL_SQL = """cells AS (SELECT DISTINCT l_suppkey AS f, l_partkey % 80 + 1000 * (l_suppkey % 10) AS cx, CAST(l_linenumber AS BIGINT) AS cy FROM lineitem),
sz AS (SELECT f, count(*) AS n FROM cells GROUP BY f), sh AS (SELECT p.f AS a, q.f AS b, count(*) AS shared FROM cells p JOIN cells q ON p.cx = q.cx AND p.cy = q.cy AND p.f < q.f GROUP BY p.f, q.f),
jac AS (SELECT a, b, shared, shared / CAST(x.n + y.n - shared AS DOUBLE) AS similarity FROM sh JOIN sz x ON x.f = a JOIN sz y ON y.f = b)"""


def _cells(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("floor_id"), (F.col("l_partkey") % 80 + 1000 * (F.col("l_suppkey") % 10)).alias("cx"), F.col("l_linenumber").cast("long").alias("cy"))


@register(f"WITH {CELL_SQL} SELECT a, b, shared, {q6('similarity')} FROM jac")
def h02_jaccard(spark, sf):
    return G.jaccard(_cells(spark, sf)).select("a", "b", "shared", r6("similarity"))


def _buildings(spark, sf):
    own, members = G.classes(_cells(spark, sf))
    own, members, links, out = stage(own, "own"), stage(members, "members"), None, None
    for t in sorted(K.BUILDING_THRESHOLDS, reverse=True):  # what holds at the higher one holds at the lower
        labels, links = G.similar_components(own, t, links)
        one = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.lit(t).alias("threshold"), F.col("floor").alias("floor_id"), F.coalesce("label", "rep").alias("building"))
        out = one if out is None else out.unionByName(one)
    return out


BUILDING_SQL = f"""RECURSIVE {CELL_SQL}, th AS (SELECT unnest([0.5, 0.4])::DOUBLE AS threshold), lk AS (SELECT threshold, a, b FROM jac, th WHERE similarity >= threshold UNION ALL SELECT threshold, b, a FROM jac, th WHERE similarity >= threshold),
reach AS (SELECT threshold, f AS s, f AS t FROM sz, th UNION SELECT reach.threshold, s, lk.b FROM reach JOIN lk ON lk.threshold = reach.threshold AND lk.a = reach.t),
bld AS (SELECT threshold, s AS floor_id, min(t) AS building FROM reach GROUP BY threshold, s)"""


@register(f"WITH {BUILDING_SQL} SELECT threshold, floor_id, building FROM bld")
def h04_buildings(spark, sf):
    return _buildings(spark, sf)


@register(f"WITH {BUILDING_SQL}, k AS (SELECT threshold, building, count(*) AS n FROM bld GROUP BY threshold, building) SELECT threshold, count(*) AS buildings, CAST(sum(n) AS BIGINT) AS floors, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, count(*) FILTER (building % 2 = 1) AS odd_fold FROM k GROUP BY threshold")
def h06_building_summary(spark, sf):
    k = _buildings(spark, sf).groupBy("threshold", "building").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("threshold").agg(F.count(F.lit(1)).alias("buildings"), F.sum("n").alias("floors"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.count_if(F.col("building") % 2 == 1).alias("odd_fold"))


@register(f"WITH {CELL_SQL}, n AS (SELECT count(*) AS n FROM sz), p AS (SELECT count(*) AS p FROM jac) SELECT CAST(floor(similarity * 10) AS BIGINT) AS bin, count(*) AS pairs FROM jac GROUP BY 1 UNION ALL SELECT -1, n * (n - 1) // 2 - p FROM n, p")
def h07_similarity_histogram(spark, sf):
    """Pairs by tenth of similarity; bin -1 holds the pairs that share no cell, by arithmetic."""
    j, n = G.similarity_counts(_cells(spark, sf))
    bins = stage(j.groupBy(F.floor(F.col("similarity") * 10).alias("bin")).agg(F.sum("pairs").alias("pairs")), "bins")
    rest = bins.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p")).join(F.broadcast(n)).select(F.lit(-1).cast("long").alias("bin"), F.expr("n * (n - 1) div 2 - p").alias("pairs"))
    return bins.unionByName(rest)


# ---- I: calibration ------------------------------------------------------------------------------------------------------

FEATURE_SQL = f"""{LADDER_SQL}, pf AS (SELECT p.plan_id, p.grp, p.kind, p.cluster, min(CASE WHEN tag <> 'Hallway' THEN round(pp, 6) END) AS pp, count(*) AS rooms FROM r JOIN plans p ON p.plan_id = r.plan_id GROUP BY p.plan_id, p.grp, p.kind, p.cluster),
rf AS (SELECT p.kind, r.plan_id, r.room_ix, r.tag, round(squareness + 1e-9, 6) AS sq FROM r JOIN plans p ON p.plan_id = r.plan_id WHERE tag <> 'Unset'), levels AS (SELECT unnest([{', '.join(map(str, K.FIT_LEVELS))}])::DOUBLE AS level)"""


def _features(spark, sf):
    rooms = _rooms(spark, sf)
    plans = table(spark, sf, "plans").select("plan_id", "grp", "kind", "cluster")
    n = rooms.groupBy("plan_id").agg(F.count(F.lit(1)).alias("rooms"))
    pf = plans.join(C.plan_features(rooms), "plan_id").join(n, "plan_id")
    return pf, C.room_features(rooms).join(plans.select("plan_id", "kind"), "plan_id")


def _levels(spark):
    return spark.createDataFrame([(x,) for x in K.FIT_LEVELS], "level double")


@register(f"WITH {FEATURE_SQL} SELECT plan_id, grp, kind, {q6('pp')}, rooms FROM pf")
def i01_plan_features(spark, sf):
    return _features(spark, sf)[0].select("plan_id", "grp", "kind", r6("pp"), "rooms")


FIT2_SQL = f"""{FEATURE_SQL}, nn AS (SELECT kind, count(*) AS n, count(pp) AS m FROM pf GROUP BY kind), want AS (SELECT kind, level, m, CAST(round_even(level * n, 0) AS BIGINT) AS k FROM nn, levels),
rk2 AS (SELECT kind, pp, row_number() OVER (PARTITION BY kind ORDER BY pp) AS rank FROM pf WHERE pp IS NOT NULL),
fit2 AS (SELECT w.kind, level, CASE WHEN k <= 0 THEN min(pp) WHEN k >= m THEN max(pp) + 1e-9 ELSE (min(pp) + max(pp)) / 2 END AS compactness FROM want w JOIN rk2 ON rk2.kind = w.kind AND rank BETWEEN greatest(least(k, m), 1) AND greatest(least(k + 1, m), 1) GROUP BY w.kind, level, k, m)"""


@register(f"WITH {FIT2_SQL} SELECT kind, level, {q6('compactness')} FROM fit2")
def i07_fit_rung2(spark, sf):
    return C.fit_rung2(_features(spark, sf)[0], _levels(spark), "kind").select("kind", "level", r6("compactness"))


@register(f"WITH {FEATURE_SQL}, ps AS (SELECT 0.05 AS p) SELECT kind, tag, round(quantile_cont(sq, 0.05) + 1e-9, 6) AS floor FROM rf GROUP BY kind, tag")
def i08_tag_quantiles(spark, sf):
    rooms = _features(spark, sf)[1]
    knobs = spark.createDataFrame([(k, 0.05, 0.05) for k in K.COMPACTNESS_FLOOR], "kind string, level double, p double")
    return C.tag_quantiles(rooms, knobs, "kind").select("kind", "tag", r6("floor"))


FIT3_SQL = f"""{FEATURE_SQL}, pool AS (SELECT kind, tag, sq, row_number() OVER (PARTITION BY kind, tag ORDER BY sq) AS i, count(*) OVER (PARTITION BY kind, tag) AS n FROM rf),
nx AS (SELECT kind, tag, sq, i, n, lead(sq) OVER (PARTITION BY kind, tag ORDER BY i) AS nxt FROM pool),
tv AS (SELECT rf.kind, rf.plan_id, rf.tag, rf.sq + 0.001 AS s, nx.sq AS vj, nx.nxt, nx.i AS j, nx.n FROM rf ASOF JOIN nx ON rf.kind = nx.kind AND rf.tag = nx.tag AND rf.sq + 0.001 >= nx.sq),
lastj AS (SELECT kind, tag, sq, max(i) AS i FROM pool GROUP BY kind, tag, sq),
tp AS (SELECT tv.kind, plan_id, CASE WHEN lj.i >= tv.n OR (tv.tag IN ('Bedroom', 'PrimaryBedroom') AND s >= 0.6) THEN NULL ELSE (lj.i - 1 + (s - tv.vj) / (n2.nxt - tv.vj)) / (tv.n - 1) END AS p FROM tv JOIN lastj lj ON lj.kind = tv.kind AND lj.tag = tv.tag AND lj.sq = tv.vj JOIN nx n2 ON n2.kind = tv.kind AND n2.tag = tv.tag AND n2.i = lj.i),
lp3 AS (SELECT pf.kind, pf.plan_id, min(p) AS p FROM pf LEFT JOIN tp ON tp.kind = pf.kind AND tp.plan_id = pf.plan_id GROUP BY pf.kind, pf.plan_id),
n3 AS (SELECT kind, count(*) AS n, count(p) AS m FROM lp3 GROUP BY kind), want3 AS (SELECT kind, level, m, least(CAST(round_even(level * n, 0) AS BIGINT), m) AS k FROM n3, levels),
rk3 AS (SELECT kind, p, row_number() OVER (PARTITION BY kind ORDER BY p) AS rank FROM lp3 WHERE p IS NOT NULL),
fit3 AS (SELECT w.kind, level, CASE WHEN k <= 0 THEN min(p) WHEN count(*) < 2 THEN least(max(p) + 1e-9, 1.0) ELSE (min(p) + max(p)) / 2 END AS p FROM want3 w JOIN rk3 ON rk3.kind = w.kind AND rank IN (k, k + 1) GROUP BY w.kind, level, k, m)"""


@register(f"WITH {FIT3_SQL} SELECT kind, level, {q6('p')} FROM fit3")
def i09_fit_rung3(spark, sf):
    pf, rf = _features(spark, sf)
    return C.fit_rung3(pf, rf, _levels(spark), "kind").select("kind", "level", r6("p"))


@register(f"WITH {FIT3_SQL}, at20 AS (SELECT f.kind, f.level, k.tag, f.p * (k.n - 1) AS at_ FROM fit3 f JOIN (SELECT DISTINCT kind, tag, n FROM pool) k ON k.kind = f.kind) SELECT a.kind, a.level, a.tag, round_even(l.sq + (at_ - floor(at_)) * (h.sq - l.sq), 4) AS floor FROM at20 a JOIN pool l ON l.kind = a.kind AND l.tag = a.tag AND l.i = floor(at_) + 1 JOIN pool h ON h.kind = a.kind AND h.tag = a.tag AND h.i = ceil(at_) + 1")
def i20_emitted_floors(spark, sf):
    """The floors of every level by kind and tag, at four decimals."""
    pf, rf = _features(spark, sf)
    knobs = C.fit_rung3(pf, rf, _levels(spark), "kind")
    return C.tag_quantiles(rf, knobs, "kind").select("kind", "level", "tag", F.bround("floor", 4).alias("floor"))


SPLITS = K.SPLITS


def split_sql() -> str:
    u = U(f"'{K.SPLIT_SEED}'", "CAST(split AS VARCHAR)", "cluster")
    return f"spl AS (SELECT split, cluster, row_number() OVER (PARTITION BY split ORDER BY u, cluster) <= count(*) OVER (PARTITION BY split) // 2 AS fitted FROM (SELECT split, cluster, {u} AS u FROM (SELECT DISTINCT cluster FROM pf), (SELECT unnest(generate_series(1, {SPLITS})) AS split)))"


@register(f"WITH {FEATURE_SQL}, {split_sql()} SELECT CAST(split AS INTEGER) AS split, cluster, fitted FROM spl")
def i12_split_halves(spark, sf):
    splits = spark.range(1, SPLITS + 1).select(F.col("id").cast("int").alias("split"))
    return C.split_halves(_features(spark, sf)[0], "cluster", splits)


@register(f"""WITH {FEATURE_SQL}, {split_sql()}, b AS (SELECT split, fitted, pf.* FROM pf JOIN spl ON spl.cluster = pf.cluster), nn AS (SELECT split, kind, count(*) AS n, count(pp) AS m FROM b WHERE fitted GROUP BY split, kind), want AS (SELECT split, kind, level, m, CAST(round_even(level * n, 0) AS BIGINT) AS k FROM nn, levels),
rk AS (SELECT split, kind, pp, row_number() OVER (PARTITION BY split, kind ORDER BY pp) AS rank FROM b WHERE fitted AND pp IS NOT NULL),
ft AS (SELECT w.split, w.kind, level, CASE WHEN k <= 0 THEN min(pp) WHEN k >= m THEN max(pp) + 1e-9 ELSE (min(pp) + max(pp)) / 2 END AS floor FROM want w JOIN rk ON rk.split = w.split AND rk.kind = w.kind AND rank BETWEEN greatest(least(k, m), 1) AND greatest(least(k + 1, m), 1) GROUP BY w.split, w.kind, level, k, m)
SELECT CAST(b.split AS INTEGER) AS split, level, grp, count(*) AS plans, count(*) FILTER (coalesce(pp < floor, FALSE)) AS refused FROM b JOIN ft ON ft.split = b.split AND ft.kind = b.kind WHERE NOT fitted GROUP BY b.split, level, grp""")
def i15_sweep(spark, sf):
    """Compactness fitted on one half at each level and split, and what it refuses of the other half."""
    pf = stage(_features(spark, sf)[0], "features")
    splits = spark.range(1, SPLITS + 1).select(F.col("id").cast("int").alias("split"))
    both = pf.join(C.split_halves(pf, "cluster", splits), "cluster")
    fitted = C.fit_rung2(both.where("fitted"), _levels(spark), "split", "kind")
    counted = both.where("NOT fitted").groupBy("split", "kind", "grp", "pp").agg(F.count(F.lit(1)).alias("n"))
    held = counted.join(F.broadcast(fitted), ["split", "kind"])
    return held.groupBy("split", "level", "grp").agg(F.sum("n").alias("plans"), F.sum(F.when(C.rung2_fails(F.col("pp"), F.col("compactness")), F.col("n")).otherwise(F.lit(0).cast("long"))).alias("refused"))


@register(f"WITH {LADDER_SQL}, x AS (SELECT *, CASE " + " ".join(f"WHEN rooms BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in K.ROOM_BINS) + " END AS bin FROM graded) SELECT grp, bin, count(*) AS plans, count(*) FILTER (f2) AS refused FROM x WHERE bin IS NOT NULL GROUP BY grp, bin")
def i17_by_room_count(spark, sf):
    g = _graded(spark, sf).select("grp", "rooms", F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False)).alias("refused"))
    return C.by_room_count(g)


@register(f"WITH {LADDER_SQL}, e AS (SELECT * FROM (SELECT DISTINCT grp FROM graded), (VALUES (TRUE), (FALSE)) a(r2), (VALUES (TRUE), (FALSE)) b(r3), (VALUES (TRUE), (FALSE)) c(r4)) SELECT e.grp, r2, r3, r4, count(g.grp) AS plans FROM e LEFT JOIN graded g ON g.grp = e.grp AND g.f2 = r2 AND g.f3 = r3 AND g.f4 = r4 GROUP BY e.grp, r2, r3, r4")
def i18_overlap(spark, sf):
    g = _graded(spark, sf)
    g = g.select("grp", F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False)).alias("r2"), F.coalesce(F.col("proportion.margin") < -K.ABS_TOL_M, F.lit(False)).alias("r3"), F.col("appendix").isNotNull().alias("r4"))
    return C.overlap(g)


@register(f"WITH {LADDER_SQL} SELECT grp, count(*) AS plans, count(*) FILTER (passed) AS graded_passes, count(*) FILTER (NOT f2 AND NOT f3 AND NOT f4) AS composed_passes, 0 AS disagree FROM graded GROUP BY grp")
def i19_reproduce(spark, sf):
    """The walked ladder against the composition of independent checks."""
    g = _graded(spark, sf)
    composed = ~F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False)) & ~F.coalesce(F.col("proportion.margin") < -K.ABS_TOL_M, F.lit(False)) & F.col("appendix").isNull()
    walked = F.coalesce("passed", F.lit(False))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("plans"), F.count_if(walked).alias("graded_passes"), F.count_if(composed).alias("composed_passes"), F.count_if(walked != composed).cast("int").alias("disagree"))
