"""Registered queries of rings: outlines of floors and entries on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.core.staging import stage_by
from plangauge.operators import rings as R
from plangauge.plans.catalog import B, S, q6, r6, register
from plangauge.plans.gating import ENDS_SQL, OPEN_SQL
from plangauge.sources.bridge import staged_edges

G = R.GRAIN
UNION_SQL = OPEN_SQL[: OPEN_SQL.index("gp AS (")]
#: Pieces with the floor to their left, what follows each, and a walk from the least piece of every ring. RECURSIVE goes before it.
RINGS_SQL = f"""{B}, {ENDS_SQL}, {UNION_SQL}
ug AS (SELECT plan_id, CAST(round(x0 * {G}) AS BIGINT) AS x0, CAST(round(x1 * {G}) AS BIGINT) AS x1, CAST(round(lo0 * {G}) AS BIGINT) AS lo0, CAST(round(lo1 * {G}) AS BIGINT) AS lo1, CAST(round(hi0 * {G}) AS BIGINT) AS hi0, CAST(round(hi1 * {G}) AS BIGINT) AS hi1 FROM un),
mk AS (SELECT plan_id, x, y, sum(l) AS l, sum(r) AS r FROM (SELECT plan_id, x0 AS x, lo0 AS y, 0 AS l, 1 AS r FROM ug UNION ALL SELECT plan_id, x0, hi0, 0, -1 FROM ug UNION ALL SELECT plan_id, x1, lo1, 1, 0 FROM ug UNION ALL SELECT plan_id, x1, hi1, -1, 0 FROM ug) GROUP BY plan_id, x, y),
vt AS (SELECT plan_id, x, y, lead(y) OVER w AS y1, sum(l) OVER w > 0 AS l, sum(r) OVER w > 0 AS r FROM mk WINDOW w AS (PARTITION BY plan_id, x ORDER BY y)),
pc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY ax, ay, bx, by_) - 1 AS id FROM (SELECT plan_id, x0 AS ax, lo0 AS ay, x1 AS bx, lo1 AS by_ FROM ug UNION ALL SELECT plan_id, x1, hi1, x0, hi0 FROM ug
  UNION ALL SELECT plan_id, x, CASE WHEN l THEN y ELSE y1 END, x, CASE WHEN l THEN y1 ELSE y END FROM vt WHERE l <> r AND y1 IS NOT NULL) WHERE ax <> bx OR ay <> by_),
ie AS (SELECT *, row_number() OVER (PARTITION BY plan_id, x, y ORDER BY angle) AS k, min(angle) OVER (PARTITION BY plan_id, x, y) AS first, count(*) OVER (PARTITION BY plan_id, x, y) AS n FROM (SELECT plan_id, id, bx AS x, by_ AS y, atan2(ay - by_, ax - bx) AS angle FROM pc)),
oe AS (SELECT *, row_number() OVER (PARTITION BY plan_id, x, y ORDER BY angle) AS turn, min(angle) OVER (PARTITION BY plan_id, x, y) AS least_ FROM (SELECT plan_id, id AS nx, ax AS x, ay AS y, atan2(by_ - ay, bx - ax) AS angle FROM pc)),
nx AS MATERIALIZED (SELECT ie.plan_id, id, nx FROM ie JOIN oe ON ie.plan_id = oe.plan_id AND ie.x = oe.x AND ie.y = oe.y AND turn = CASE WHEN least_ < first THEN k ELSE (k - 2 + n) % n + 1 END),
walk AS (SELECT plan_id, id AS start, id AS at_, 0 AS pos FROM nx UNION ALL SELECT w.plan_id, w.start, n.nx, pos + 1 FROM walk w JOIN nx n ON n.plan_id = w.plan_id AND n.id = w.at_ WHERE n.nx > w.start),
rn AS (SELECT w.plan_id, w.start, pos, ax / {G}.0 AS x, ay / {G}.0 AS y FROM walk w JOIN (SELECT w.plan_id, w.start FROM walk w JOIN nx n ON n.plan_id = w.plan_id AND n.id = w.at_ WHERE n.nx = w.start) c ON c.plan_id = w.plan_id AND c.start = w.start JOIN pc ON pc.plan_id = w.plan_id AND pc.id = w.at_),
ry AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lag(x) OVER w, arg_max(x, pos) OVER p) AS px, coalesce(lag(y) OVER w, arg_max(y, pos) OVER p) AS py FROM rn WINDOW w AS (PARTITION BY plan_id, start ORDER BY pos), p AS (PARTITION BY plan_id, start)),
ra AS (SELECT *, sum((x * ny - nx * y) / 2) OVER (PARTITION BY plan_id, start) AS area2 FROM ry),
rings AS MATERIALIZED (SELECT plan_id, dense_rank() OVER (PARTITION BY plan_id ORDER BY start) - 1 AS ring, row_number() OVER (PARTITION BY plan_id, start ORDER BY pos) - 1 AS seq, x, y, area2 FROM ra WHERE abs((nx - px) * (y - py) - (ny - py) * (x - px)) > {R.STRAIGHT} * sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)))"""


@register(f"WITH RECURSIVE {RINGS_SQL} SELECT plan_id, ring, seq, {q6('x')}, {q6('y')}, {q6('area2')} FROM rings")
def d06_outline_rings(spark, sf):
    """The rings around each floor and its holes, vertex by vertex."""
    return R.outlines(*staged_edges(spark, sf)).select("plan_id", F.col("ring").cast("long"), F.col("seq").cast("long"), r6("x"), r6("y"), r6("area2"))


@register(f"""WITH RECURSIVE {RINGS_SQL}, hm AS (SELECT plan_id, arg_max(ring, (round(area2, 6), -ring)) AS ring FROM rings WHERE area2 > 0 GROUP BY plan_id),
pt AS (SELECT plan_id, (min(ix) + max(ix)) / 2.0 AS px, -7.0 AS py FROM vertices WHERE plan_id % 5 <> 0 GROUP BY plan_id),
e AS (SELECT r.plan_id, seq AS edge, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) - x AS dx, coalesce(lead(y) OVER w, first_value(y) OVER w) - y AS dy FROM rings r JOIN hm ON hm.plan_id = r.plan_id AND hm.ring = r.ring WINDOW w AS (PARTITION BY r.plan_id ORDER BY seq)),
s AS (SELECT e.*, px, py, px IS NULL AS synthetic, CASE WHEN px IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))) END AS station FROM e LEFT JOIN pt ON pt.plan_id = e.plan_id),
d AS (SELECT *, x + station * dx AS qx, y + station * dy AS qy, CASE WHEN synthetic THEN 0.0 ELSE sqrt((x + station * dx - px) * (x + station * dx - px) + (y + station * dy - py) * (y + station * dy - py)) END AS d FROM s),
k AS (SELECT plan_id, edge, station, qx * {S} AS x_m, qy * {S} AS y_m, d * {S} AS offset_m, synthetic, row_number() OVER (PARTITION BY plan_id ORDER BY round(CASE WHEN synthetic THEN -sqrt(dx * dx + dy * dy) ELSE d END, 6), edge) AS n FROM d)
SELECT plan_id, edge, {q6('station')}, {q6('x_m')}, {q6('y_m')}, {q6('offset_m')}, synthetic FROM k WHERE n = 1""")
def d16_outline_entry(spark, sf):
    """A point seven steps below the middle of a plan, put onto its outline; every fifth plan has none and takes the middle of its longest edge."""
    edges, n = staged_edges(spark, sf)
    points = edges.where("plan_id % 5 <> 0").groupBy("plan_id").agg(((F.min("ax") + F.max("ax")) / 2.0).alias("px"), F.lit(-7.0).alias("py"))
    e = R.entry_on_outline(stage_by(R.outlines(edges, n), "plan_id", "rings", n), points)
    return e.select("plan_id", F.col("edge").cast("long"), r6("station"), r6("x_m"), r6("y_m"), r6("offset_m"), "synthetic")
