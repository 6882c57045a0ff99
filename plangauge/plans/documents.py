"""Registered queries over documents, dimensions and the remaining statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core import dimensions as D
from plangauge.operators import calibration as C
from plangauge.operators import measures as M
from plangauge.operators import outcomes as O
from plangauge.plans import catalog as Q
from plangauge.plans.catalog import B, CELL_SQL, EVENT_SQL, FEATURE_SQL, FIT3_SQL, LADDER_SQL, REPLICATES, S, q6, r6, register
from plangauge.sources import documents as A
from plangauge.sources.bridge import table


def _documents(spark, sf):
    return A.as_documents(table(spark, sf, "vertices"), table(spark, sf, "plans"), table(spark, sf, "access"))


#: plan_id % 20 to (the fault's reason, SQL that puts the fault into a document's text).
FAULTS = {
    1: ("malformed-json", "substr(text, 1, length(text) - 1)"),
    2: ("no-rooms", "regexp_replace(text, '\"rooms\":', '\"room\":')"),
    3: ("missing-source", "regexp_replace(text, '\"source\":', '\"sauce\":')"),
    4: ("missing-category", "regexp_replace(text, '\"category\":\"[a-z]+\"', '\"category\":\"\"')"),
    5: ("malformed-point", "regexp_replace(text, '\\\\[\\\\[0\\\\.0,', '[[\"x\",')"),
    6: ("non-finite-coordinate", "regexp_replace(text, '\\\\[\\\\[0\\\\.0,', '[[NaN,')"),
    7: ("malformed-plan", "concat('[', text, ']')"),
    8: ("malformed-room", "regexp_replace(text, '\"rooms\":\\\\[', '\"rooms\":[7,')"),
    9: ("room-with-hole", "regexp_replace(text, '\"ring\":', '\"holes\":[],\"ring\":')"),
    10: ("malformed-adjacency", "regexp_replace(text, '\"adjacency\":\\\\[', '\"adjacency\":[[0,99],')"),
    11: ("malformed-ring", "regexp_replace(text, '\"ring\":\\\\[', '\"ring\":7,\"old\":[')"),
}


@register(f"WITH {B} SELECT plan_id, CASE plan_id % 20 " + " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in FAULTS.items()) + " END AS reason FROM (SELECT DISTINCT plan_id FROM vertices) WHERE plan_id % 20 <> 10 OR plan_id IN (SELECT plan_id FROM access)")
def b01_validate(spark, sf):
    """Documents with a fault put into each by plan number, and the reason found."""
    d = _documents(spark, sf)
    broken = d.withColumn("text", F.expr("CASE plan_id % 20 " + " ".join(f"WHEN {k} THEN {e}" for k, (_, e) in FAULTS.items()) + " ELSE text END"))
    some = table(spark, sf, "access").select("plan_id").distinct().withColumn("linked", F.lit(True))
    return A.validated(broken).join(some, "plan_id", "left").where("plan_id % 20 <> 10 OR linked").select("plan_id", "reason")


@register(f"WITH {B} SELECT plan_id, room_ix, category, vix, ix AS qx, iy AS qy FROM vertices")
def a01_documents_round_trip(spark, sf):
    """Documents written (A15) and read again (A1, A5): the same vertices."""
    r = A.rooms_of(A.validated(_documents(spark, sf)).where("reason IS NULL"), "plan_id")
    return r.select("plan_id", "room_ix", "category", "vix", M.quantise(F.col("x")).alias("qx"), M.quantise(F.col("y")).alias("qy"))


@register(f"WITH {B} SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY edge_ix) - 1 AS INTEGER) AS place, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM access")
def b04_adjacency(spark, sf):
    return A.adjacency_of(A.validated(_documents(spark, sf)), "plan_id")


@register(f"WITH {B} SELECT grp, count(*) AS plans, CASE grp WHEN 'msd units' THEN 'msd' ELSE grp END AS source, CASE WHEN grp LIKE 'msd%' THEN 'msd' ELSE 'rplan' END AS corpus FROM plans GROUP BY grp")
def a03_manifest_lookup(spark, sf):
    """Group and corpus by precedence: a manifest with a directory in the other slash style, and one group that it lacks."""
    plans = table(spark, sf, "plans")
    manifest = spark.createDataFrame([("msd units", "msd", "C:\\runs\\unit\\"), ("housegan", "rplan", "runs/housegan/")], "group string, corpus string, directory string")
    docs = plans.select("plan_id", F.when(F.col("grp") == "msd units", "unit").otherwise(F.col("grp")).alias("directory"), F.when(F.col("grp") == "rplan", "rplan").alias("meta_group"), F.lit(None).cast("string").alias("meta_corpus"))
    found = A.corpus_of(docs, manifest)
    return found.groupBy(F.col("group").alias("grp"), "corpus").agg(F.count(F.lit(1)).alias("plans")).withColumn("source", A.source_token(F.col("grp"))).select("grp", "plans", "source", "corpus")


@register("SELECT o_orderkey AS plan_id, ix FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ix FROM orders) WHERE ix >= 5 AND (ix - 5) % 7 = 0 AND ix < 5 + 7 * 100")
def a09_systematic_sample(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("plan_id"))
    return A.systematic_sample(o, "plan_id", 7, 5, 100).select("plan_id", "ix")


@register("SELECT c_custkey, regexp_replace(c_name || ' /' || c_mktsegment, '[^A-Za-z0-9._#-]', '_', 'g') AS name FROM customer")
def a16_safe_names(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", A.safe_name(F.concat_ws("", "c_name", F.lit(" /"), "c_mktsegment")).alias("name"))


@register(f"""WITH {B}, n AS (SELECT grp, count(*) AS written FROM plans GROUP BY grp), o AS (SELECT * FROM (VALUES (0, 'gone', 5, 'x/gone'), (1, 'housegan', 1, 'x/housegan'), (2, 'rplan', 1, 'x/rplan')) AS t(place, "group", written, directory)),
p AS (SELECT grp, written, row_number() OVER (ORDER BY grp) - 1 AS np FROM n)
SELECT CAST(row_number() OVER (ORDER BY o.place NULLS LAST, np) - 1 AS INTEGER) AS place, coalesce(o."group", p.grp) AS "group", coalesce(p.written, o.written) AS written, coalesce('y/' || p.grp, o.directory) AS directory FROM o FULL JOIN p ON o."group" = p.grp""")
def a17_manifest_upsert(spark, sf):
    n = table(spark, sf, "plans").groupBy("grp").agg(F.count(F.lit(1)).alias("written"))
    new = n.select((F.row_number().over(M.Window.orderBy("grp")) - 1).alias("place"), F.col("grp").alias("group"), "written", F.concat(F.lit("y/"), F.col("grp")).alias("directory"))
    old = spark.createDataFrame([(0, "gone", 5, "x/gone"), (1, "housegan", 1, "x/housegan"), (2, "rplan", 1, "x/rplan")], "place int, group string, written long, directory string")
    return A.merged_manifest(old, new)


#: Plans with what they state, a third of them, and the source that they name.
SOURCED = "(SELECT plan_id, grp, CASE WHEN plan_id % 3 = 0 THEN CAST(pixel AS DOUBLE) END AS stated, CASE grp WHEN 'msd units' THEN 'msd' ELSE grp END AS source FROM plans)"


@register(f"WITH {B}, known AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, CAST({v} AS DOUBLE))' for n, v in K.SOURCE_PIXEL_M.items())}) AS t(source, m)), s AS (SELECT plan_id, s.source, coalesce(stated, m) AS pixel FROM {SOURCED} s LEFT JOIN known ON known.source = s.source) SELECT plan_id, source, pixel, pixel + {S} AS tolerance, CASE WHEN pixel IS NULL THEN 'unknown-source-pixel' END AS refusal FROM s")
def b05_source_pixel(spark, sf):
    """The pixel that a plan states, else that of its source, the seam tolerance it gives, and the refusal where there is none."""
    p = table(spark, sf, SOURCED).select("plan_id", "source", D.source_pixel(F.col("stated"), F.col("source")).alias("pixel"))
    return p.select("*", (F.col("pixel") + K.STEP_M).alias("tolerance"), F.when(F.col("pixel").isNull(), "unknown-source-pixel").alias("refusal"))


@register(f"WITH {B} SELECT category, {D.tag_sql()} AS tag, {D.tag_sql()} = 'Hallway' AS hallway, category IN ('corridor', 'stairs') AS circulation, category = 'bathroom' AS wet, count(*) AS rooms FROM (SELECT CASE WHEN room_ix % 5 = 0 THEN ' ' || upper(category) ELSE category END AS category FROM rooms) GROUP BY category")
def b06_tags(spark, sf):
    """Tags, hallways (B7) and room classes (B13), spelling aside."""
    r = table(spark, sf, "rooms").select(F.when(F.col("room_ix") % 5 == 0, F.concat(F.lit(" "), F.upper("category"))).otherwise(F.col("category")).alias("category"))
    n = r.groupBy("category").agg(F.count(F.lit(1)).alias("rooms"))
    return n.select("category", D.tag_of(F.col("category")).alias("tag"), D.is_hallway(F.col("category")).alias("hallway"), F.col("category").isin("corridor", "stairs").alias("circulation"), (F.col("category") == "bathroom").alias("wet"), "rooms")


@register(f"WITH {Q.UNITS_SQL}, n AS (SELECT plan_id, count(DISTINCT unit_ix) AS u FROM mem GROUP BY plan_id) SELECT p.plan_id, CASE WHEN corpus <> 'msd' THEN 'rplan' WHEN u > 1 THEN 'msd-floor' ELSE 'msd-unit' END AS kind FROM plans p JOIN n ON n.plan_id = p.plan_id")
def b10_floor_kind(spark, sf):
    n = Q._members(spark, sf).groupBy("plan_id").agg(F.countDistinct("unit_ix").alias("u"))
    return table(spark, sf, "plans").select("plan_id", "corpus").join(n, "plan_id").select("plan_id", D.floor_kind(F.col("corpus"), F.col("u")).alias("kind"))


@register(f"WITH {B}, floors AS (SELECT * FROM {D.floors_sql()}), t AS (SELECT plan_id, room_ix, {D.tag_sql()} AS tag FROM rooms) SELECT t.plan_id, room_ix, t.tag, CAST(coalesce(prop_req, 0.0) AS DOUBLE) AS prop_req FROM t JOIN plans p ON p.plan_id = t.plan_id LEFT JOIN floors f ON f.kind = p.kind AND f.tag = t.tag")
def b11_requirements(spark, sf):
    """Each room's proportions floor by kind and tag, 0.0 where it is disabled."""
    t = table(spark, sf, "rooms").select("plan_id", "room_ix", D.tag_of(F.col("category")).alias("tag")).join(table(spark, sf, "plans").select("plan_id", "kind"), "plan_id")
    return t.join(F.broadcast(D.floors(spark)), ["kind", "tag"], "left").select("plan_id", "room_ix", "tag", F.coalesce("prop_req", F.lit(0.0)).alias("prop_req"))


@register(f"WITH {B}, st AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {a}, {w})' for t, a, w in K.STANDARDS)}) AS s(tag, area_req, min_width)), t AS (SELECT {D.tag_sql()} AS tag, count(*) AS rooms FROM rooms GROUP BY 1) SELECT t.tag, rooms, CAST(area_req AS DOUBLE) AS area_req, CAST(min_width AS DOUBLE) AS min_width FROM t LEFT JOIN st ON st.tag = t.tag")
def a13_standards(spark, sf):
    t = table(spark, sf, "rooms").groupBy(D.tag_of(F.col("category")).alias("tag")).agg(F.count(F.lit(1)).alias("rooms"))
    return t.join(F.broadcast(D.standards(spark)), "tag", "left").select("tag", "rooms", "area_req", "min_width")


@register(f"WITH {Q.UNITS_SQL} SELECT DISTINCT plan_id || '#u' || unit_ix AS unit_id, CAST(plan_id AS VARCHAR) AS floor_id FROM mem WHERE unit_ix IS NOT NULL")
def b14_floor_of(spark, sf):
    u = Q._members(spark, sf).where("unit_ix IS NOT NULL").select(F.concat(F.col("plan_id").cast("string"), F.lit("#u"), F.col("unit_ix").cast("string")).alias("unit_id")).distinct()
    return u.select("unit_id", F.substring_index("unit_id", "#u", 1).alias("floor_id"))


@register(f"WITH {B}, k AS (SELECT DISTINCT 'b' || o_custkey % 97 AS building FROM orders WHERE o_custkey % 13 <> 0) SELECT count(*) AS missing FROM (SELECT DISTINCT cluster FROM plans WHERE grp = 'msd units') c WHERE cluster NOT IN (SELECT building FROM k)")
def g15_missing_buildings(spark, sf):
    """Floors that the building key lacks, by anti join."""
    key = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 13 <> 0").select(F.concat(F.lit("b"), (F.col("o_custkey") % 97).cast("string")).alias("cluster")).distinct()
    return table(spark, sf, "plans").where("grp = 'msd units'").select("cluster").distinct().join(key, "cluster", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@register(f"WITH {LADDER_SQL} SELECT p.grp, p.cluster, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) AS admitted, count(*) FILTER (not_run IS NULL) AS verdict FROM graded g JOIN plans p ON p.plan_id = g.plan_id WHERE p.grp = 'msd units' GROUP BY p.grp, p.cluster")
def g14_building_totals(spark, sf):
    """Flags of graded plans summed by building (G14, G16, G21)."""
    g = Q._graded(spark, sf).join(table(spark, sf, "plans").select("plan_id", "cluster"), "plan_id").where("grp = 'msd units'")
    return O.cluster_totals(g)


@register(f"""WITH {EVENT_SQL}, {Q.ROLES_SQL}, t AS (SELECT grp, cluster, count(*) AS graded, count(*) FILTER (passed) AS p1, count(*) FILTER (passed OR (admitted AND not_run IS NULL AND cluster % 9 = 0)) AS p2 FROM v GROUP BY grp, cluster),
{Q.resample_sql('graded', 'p1', 'p2')},
m AS (SELECT replicate, {' - '.join(f"(min(CASE WHEN role = 'truth' THEN 100 * {p} / CAST(graded AS DOUBLE) END) - max(CASE WHEN role = 'baseline' THEN 100 * {p} / CAST(graded AS DOUBLE) END))" for p in ('p2', 'p1'))} AS shift FROM rp JOIN roles ON roles.grp = rp.grp GROUP BY replicate)
SELECT round(quantile_cont(shift, 0.025) + 1e-9, 6) + 0.0 AS low, round(quantile_cont(shift, 0.975) + 1e-9, 6) + 0.0 AS high FROM m""")
def g20_paired_shift(spark, sf):
    """The margin under a second rule less that under the first, on the same resamples: one row of totals holds both rules."""
    second = F.col("passed") | (F.col("admitted") & F.col("not_run").isNull() & (F.col("cluster") % 9 == 0))
    totals = Q._events(spark, sf).groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("graded"), F.count_if("passed").alias("p1"), F.count_if(second).alias("p2"))
    r = O.cluster_replicates(totals, REPLICATES).join(F.broadcast(D.groups(spark).select("grp", "role")), "grp")
    side = lambda role, p: F.when(F.col("role") == role, 100 * F.col(p) / F.col("graded"))
    margin = lambda p: F.min(side("truth", p)) - F.max(side("baseline", p))
    return O.interval(r.groupBy("replicate").agg((margin("p2") - margin("p1")).alias("shift")), "shift").select(r6("low"), r6("high"))


def _own_sql(population: str, where: str) -> str:
    return f"(WITH {Q.MARGIN_SQL.replace('FROM events)', f'FROM events WHERE {where})')} SELECT '{population}' AS population, denominator, CASE WHEN role = 'truth' THEN grp END AS truth, CASE WHEN role = 'baseline' THEN grp END AS baseline, passed, total, rate, low, high FROM w UNION ALL SELECT '{population}', denominator, truth, baseline, NULL, NULL, margin, low, high FROM mg)"


@register(f"SELECT population, denominator, truth, baseline, passed, total, {q6('rate')}, {q6('low')}, {q6('high')} FROM ({_own_sql('even', 'user_id % 2 = 0')} UNION ALL {_own_sql('odd', 'user_id % 2 = 1 AND event_type IN (' + repr('click') + ', ' + repr('view') + ')')})")
def g24_own_rates(spark, sf):
    """Rates and margins of two populations of events, the second of which has no baseline and so no margin."""
    e = Q._events(spark, sf).withColumn("population", F.when(F.col("cluster") % 2 == 0, "even").otherwise("odd")).where("population = 'even' OR grp IN ('rplan', 'msd units')")
    return O.own_rates(e, D.groups(spark), "population").select("population", "denominator", "truth", "baseline", "passed", "total", r6("rate"), r6("low"), r6("high"))


@register(f"WITH {CELL_SQL} SELECT f AS floor_id, count(*) AS cells FROM cells GROUP BY f")
def h01_structure_cells(spark, sf):
    """Distinct cells of a floor, from points rounded half to even."""
    return Q._cells(spark, sf).distinct().groupBy("floor_id").agg(F.count(F.lit(1)).alias("cells"))


@register(f"WITH {Q.BUILDING_SQL} SELECT threshold, floor_id, building % 2 AS fold FROM bld")
def h05_building_folds(spark, sf):
    return Q._buildings(spark, sf).select("threshold", "floor_id", (F.col("building") % 2).alias("fold"))


@register(f"WITH {LADDER_SQL} SELECT kind, count(*) AS plans, count(*) FILTER (f2) AS rung2, count(*) FILTER (f3) AS rung3, count(*) FILTER (NOT f2 AND NOT f3 AND NOT f4) AS clear FROM graded GROUP BY kind")
def i05_refused_alone(spark, sf):
    """Plans that each check refuses by itself, every plan under its own kind's floors (I5, I6)."""
    pf, rf = Q._features(spark, sf)
    floors = D.floors(spark).select("kind", "tag", F.col("prop_req").alias("floor"))
    r3 = C.rung3_refused(rf, floors, ["kind", "tag"]).select("plan_id", F.lit(True).alias("f3"))
    g = Q._graded(spark, sf).select("plan_id", "kind", F.coalesce(F.col("compact.score") < F.col("compactness"), F.lit(False)).alias("f2"), F.col("appendix").isNotNull().alias("f4"))
    g = g.join(r3, "plan_id", "left").withColumn("f3", F.coalesce("f3", F.lit(False)))
    return g.groupBy("kind").agg(F.count(F.lit(1)).alias("plans"), F.count_if("f2").alias("rung2"), F.count_if("f3").alias("rung3"), F.count_if(~F.col("f2") & ~F.col("f3") & ~F.col("f4")).alias("clear"))


@register(f"WITH {FEATURE_SQL} SELECT plan_id, coalesce(CASE WHEN plan_id % 4 <> 0 THEN cluster END, 'floor:' || plan_id) AS cluster FROM pf WHERE grp = 'msd units'")
def i13_attach_buildings(spark, sf):
    pf = Q._features(spark, sf)[0].where("grp = 'msd units'").drop("cluster")
    key = table(spark, sf, "plans").where("plan_id % 4 <> 0").select(F.col("plan_id").alias("floor_id"), F.col("cluster").alias("building"))
    return C.attach_cluster(pf, key, "plan_id", "plan_id").select("plan_id", "cluster")


@register(f"WITH {FIT3_SQL}, s AS (SELECT kind, avg(p) AS mean_p, min(p) AS least_p, max(p) AS most_p FROM fit3 GROUP BY kind) SELECT kind, {q6('mean_p')}, {q6('least_p')}, {q6('most_p')} FROM s")
def i16_spread(spark, sf):
    """Mean, least and greatest knob over the levels."""
    pf, rf = Q._features(spark, sf)
    return C.fit_rung3(pf, rf, Q._levels(spark), "kind").groupBy("kind").agg(F.avg("p").alias("mean_p"), F.min("p").alias("least_p"), F.max("p").alias("most_p")).select("kind", r6("mean_p"), r6("least_p"), r6("most_p"))
