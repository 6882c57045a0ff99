"""Registered queries over record files, coded records, manifests, caches and per-plan notes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core import dimensions as D
from plangauge.core.staging import shared_dir, stage
from plangauge.operators import coverage as V
from plangauge.operators import graph as G
from plangauge.operators import measures as M
from plangauge.operators import outcomes as O
from plangauge.plans import catalog as Q
from plangauge.plans.catalog import B, S, UNITS_SQL, q6, r6, register
from plangauge.plans.documents import FAULTS, _documents
from plangauge.sources import documents as A
from plangauge.sources import records as R
from plangauge.sources.bridge import staged_edges, table


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, sf):
    """Sample records as text: every third room clockwise, rooms of some parts with two points only, one link too many in each plan."""
    v = table(spark, sf, "vertices").join(table(spark, sf, "rooms").select("plan_id", "room_ix", "l_partkey"), ["plan_id", "room_ix"]).where("l_partkey % 19 <> 0 OR vix < 2")
    at = F.when(F.col("room_ix") % 3 == 0, -F.col("vix")).otherwise(F.col("vix"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.array(F.col("ix").cast("double"), F.col("iy").cast("double")).alias("p")))), lambda x: x["p"])
    rooms = v.groupBy("plan_id", "room_ix", "category").agg(ring.alias("ring")).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("room_ix", "category", "ring"))).alias("r"))
    rooms = rooms.select("plan_id", F.transform("r", lambda x: F.struct(x["category"].alias("category"), x["room_ix"].alias("node_index"), x["ring"].alias("ring"))).alias("rooms"))
    links = table(spark, sf, "access").groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_ix", "a", "b", "kind"))), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["kind"].alias("kind"))).alias("access"))
    extra = F.array(F.struct(F.lit(0).alias("a"), F.lit(99).alias("b"), F.lit("door").alias("kind")))
    d = rooms.join(links, "plan_id", "left").select(F.col("plan_id").alias("sample_id"), F.lit(1 / K.STEP_M).alias("units_per_metre"), "rooms", F.concat(F.coalesce("access", F.array()), extra).alias("access"))
    return d.select("sample_id", (F.col("sample_id") % 7).alias("shard"), F.concat(F.to_json(F.struct("*")), F.when(F.col("sample_id") % 5 == 0, "\n  ").otherwise("")).alias("value"))


def _read(spark, sf, limit=None):
    path = _folder(spark, "records")
    R.write_lines(_lines(spark, sf), path, "shard", "sample_id")
    return R.read_lines(spark, path, "shard", limit)


KEPT_SQL = f"{B}, kp AS (SELECT plan_id, room_ix, category, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY room_ix) - 1 AS INTEGER) AS k, count(*) OVER (PARTITION BY plan_id) AS n FROM rooms WHERE l_partkey % 19 <> 0)"


@register(f"WITH {B} SELECT plan_id % 7 AS shard, plan_id AS sample_id FROM (SELECT DISTINCT plan_id FROM rooms) ORDER BY 1, 2 LIMIT 500")
def a04_sample_lines(spark, sf):
    """The first 500 records in the order of the shards (the limit is the reader's own); every fifth record is followed by a blank line."""
    return _read(spark, sf, 500).select("shard", F.from_json("value", R.RECORD)["sample_id"].alias("sample_id"))


@register(f"WITH {KEPT_SQL} SELECT v.plan_id, kp.k AS room_ix, v.category, vix, ix AS qx, iy AS qy FROM vertices v JOIN kp ON kp.plan_id = v.plan_id AND kp.room_ix = v.room_ix")
def a05_sample_plans(spark, sf):
    v = R.record_vertices(R.usable(R.sample_records(_read(spark, sf))))
    return v.select("plan_id", "room_ix", "category", "vix", F.rint("x").cast("long").alias("qx"), F.rint("y").cast("long").alias("qy"))


@register(f"WITH {KEPT_SQL}, n AS (SELECT plan_id, any_value(n) AS n FROM kp GROUP BY plan_id), p AS (SELECT DISTINCT plan_id FROM rooms), e AS (SELECT a.plan_id, count(*) AS links FROM access a JOIN n ON n.plan_id = a.plan_id WHERE b < n.n GROUP BY a.plan_id) SELECT p.plan_id AS sample_id, coalesce(n, 0) AS rooms, coalesce(links, 0) AS links, CASE WHEN n IS NULL THEN 'no-usable-room' END AS refusal FROM p JOIN orders ON o_orderkey = p.plan_id AND o_custkey % 5 = 0 LEFT JOIN n ON n.plan_id = p.plan_id LEFT JOIN e ON e.plan_id = p.plan_id")
def a06_sample_lookup(spark, sf):
    """Records asked for by id, with the rooms and links that are left of them, or the refusal."""
    ids = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("sample_id"))
    found = R.usable(R.lookup(R.sample_records(_read(spark, sf)), ids))
    return found.select("sample_id", F.size("rooms").alias("rooms"), F.size("access").alias("links"), "refusal")


@register(f"""WITH {B}, n AS (SELECT grp, count(*) AS total FROM plans GROUP BY grp) SELECT grp, CASE WHEN grp <> 'rplan' THEN total END AS total, x.role, x.sha AS sha256 FROM n LEFT JOIN (VALUES ('houseganpp', 'edge', 'e1'), ('houseganpp', 'graph', 'unknown'), ('housegan', 'model.pt', 'm1'), ('msd units', 'best.pt', 'unknown')) AS x(g, role, sha) ON x.g = n.grp""")
def a07_manifest_books(spark, sf):
    """Samples written and checkpoints of each group's book, in all spellings (one book states neither)."""
    n = table(spark, sf, "plans").groupBy("grp", (F.col("plan_id") % 3).cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("per"), F.sum("n").alias("n"))
    several = F.when(F.col("grp") == "houseganpp", F.from_json(F.lit('{"graph": {}, "edge": {"sha256": "e1"}}'), "map<string, struct<sha256: string>>"))
    single = F.when(F.col("grp") == "housegan", "model.pt").when(F.col("grp") == "msd units", "best.pt")
    book = F.to_json(F.struct(F.when(F.col("grp").isin("housegan", "msd units"), F.col("n")).alias("written"), F.when(F.col("grp").isin("houseganpp", "housediffusion"), F.col("per")).alias("samples_per_bucket"), several.alias("checkpoints"), single.alias("checkpoint"), F.when(F.col("grp") == "housegan", "m1").alias("checkpoint_sha256")))
    b = per.select("grp", F.from_json(book, R.BOOK).alias("book"))
    return b.select("grp", R.sample_total(F.col("book")).alias("total"), F.explode_outer(R.checkpoints(F.col("book"))).alias("c")).select("grp", "total", "c.role", "c.sha256")


@register(f"SELECT l_partkey % 16 AS code, {R.category_sql('rplan', 'l_partkey % 16')} AS rplan, {R.category_sql('msd', 'l_partkey % 16')} AS msd, count(*) AS rooms FROM lineitem GROUP BY l_partkey % 16")
def a08_code_names(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_partkey") % 16).alias("code")).agg(F.count(F.lit(1)).alias("rooms"))
    return n.select("code", R.category_of("rplan", F.col("code")).alias("rplan"), R.category_of("msd", F.col("code")).alias("msd"), "rooms")


BOUNDARY_SQL = "bd AS (SELECT plan_id, vix AS at_, ix AS x, iy AS y FROM vertices WHERE room_ix = 0 AND (vix + plan_id) % 3 = 0), en AS (SELECT plan_id, CASE WHEN count(*) = 2 THEN avg(x) END AS x, CASE WHEN count(*) = 2 THEN avg(y) END AS y FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY at_) AS k FROM bd) WHERE k <= 2 GROUP BY plan_id)"
CODED_SQL = "nr AS (SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id), ce AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber - 1 AS INT) AS a, CAST(l_suppkey % 9 AS INT) AS b, l_partkey % 10 AS code FROM lineitem), ck AS (SELECT ce.plan_id, a, b, 'rplan_edge_unknown_' || code AS kind FROM ce JOIN nr ON nr.plan_id = ce.plan_id WHERE a <> b AND a >= 0 AND b >= 0 AND a < n AND b < n)"


def _boundary(spark, sf):
    return table(spark, sf, "vertices").where("room_ix = 0").select("plan_id", F.col("vix").alias("at"), F.col("ix").alias("x"), F.col("iy").alias("y"), ((F.col("vix") + F.col("plan_id")) % 3 == 0).cast("int").alias("flag"))


def _coded_edges(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") - 1).cast("int").alias("a"), (F.col("l_suppkey") % 9).cast("int").alias("b"), (F.col("l_partkey") % 10).alias("code"))


@register(f"WITH {B}, {BOUNDARY_SQL}, p AS (SELECT DISTINCT plan_id FROM rooms) SELECT p.plan_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p LEFT JOIN en ON en.plan_id = p.plan_id")
def a10_entry_from_boundary(spark, sf):
    return R.entry_from_boundary(_boundary(spark, sf))


@register(f"WITH {B}, {CODED_SQL} SELECT plan_id, a, b, kind FROM ck")
def a11_coded_access(spark, sf):
    n = table(spark, sf, "rooms").groupBy("plan_id").agg(F.count(F.lit(1)).alias("rooms"))
    return R.coded_access(_coded_edges(spark, sf), n)


@register(f"""WITH {KEPT_SQL}, {BOUNDARY_SQL}, {CODED_SQL}, g AS (SELECT r.plan_id, count(*) FILTER (l_partkey % 19 <> 0) AS rooms, count(*) FILTER (l_partkey % 19 = 0) AS empty, count(DISTINCT CASE WHEN l_partkey % 19 <> 0 THEN {R.category_sql('rplan', 'l_partkey % 16')} END) AS categories FROM rooms r GROUP BY r.plan_id),
l AS (SELECT ce.plan_id, count(*) AS links FROM ce JOIN g ON g.plan_id = ce.plan_id WHERE a <> b AND a >= 0 AND b >= 0 AND a < rooms AND b < rooms GROUP BY ce.plan_id)
SELECT g.plan_id, rooms, empty, categories, CAST(x AS DOUBLE) AS entry_x, CAST(y AS DOUBLE) AS entry_y, coalesce(links, 0) AS links, CASE WHEN rooms = 0 THEN 'no-usable-room' END AS refusal FROM g LEFT JOIN en ON en.plan_id = g.plan_id LEFT JOIN l ON l.plan_id = g.plan_id""")
def a21_coded_plans(spark, sf):
    """Coded records as plans: names by code, rooms without a ring dropped and counted, entry and links attached (A8, A10, A11)."""
    r = table(spark, sf, "rooms").select("plan_id", (F.col("l_partkey") % 19 != 0).alias("ring"), R.category_of("rplan", F.col("l_partkey") % 16).alias("category"))
    g = r.groupBy("plan_id").agg(F.count_if("ring").alias("rooms"), F.count_if(~F.col("ring")).alias("empty"), F.countDistinct(F.when(F.col("ring"), F.col("category"))).alias("categories"))
    links = R.coded_access(_coded_edges(spark, sf), g).groupBy("plan_id").agg(F.count(F.lit(1)).alias("links"))
    entry = R.entry_from_boundary(_boundary(spark, sf)).select("plan_id", F.col("x").alias("entry_x"), F.col("y").alias("entry_y"))
    j = g.join(entry, "plan_id", "left").join(links, "plan_id", "left")
    return j.select("plan_id", "rooms", "empty", "categories", "entry_x", "entry_y", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("rooms") == 0, "no-usable-room").alias("refusal"))


@register(f"WITH {B}, p AS (SELECT DISTINCT v.plan_id, grp FROM vertices v JOIN plans ON plans.plan_id = v.plan_id) SELECT grp, CAST(plan_id AS VARCHAR) AS stem, row_number() OVER (PARTITION BY grp ORDER BY CAST(plan_id AS VARCHAR)) - 1 AS place FROM p")
def a02_corpus_scan(spark, sf):
    """Documents written under one folder for each group (A15) and scanned again: the group is the folder's name, documents in the order of their names."""
    path = _folder(spark, "corpus")
    A.write_documents(_documents(spark, sf), path)
    files = spark.read.text(path, recursiveFileLookup=True)
    found = files.select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/grp=([^/]+)/", 1)).alias("grp"), F.get_json_object("value", "$.name").alias("stem"))
    found = found.withColumn("grp", F.url_decode(F.col("grp")))
    return O.ranked_within(found, "grp", "stem").select("grp", "stem", (F.col("pick") - 1).alias("place"))


@register(f"WITH {B}, r AS (SELECT p.grp, count(DISTINCT v.plan_id) AS documents, count(*) FILTER (vix = 0) AS rooms, count(*) AS points FROM vertices v JOIN plans p ON p.plan_id = v.plan_id GROUP BY p.grp) SELECT * FROM r")
def a15_document_sink(spark, sf):
    path = _folder(spark, "sink")
    A.write_documents(_documents(spark, sf), path)
    d = spark.read.text(path).select("grp", F.from_json("value", "struct<rooms: array<struct<ring: array<array<double>>>>>").alias("d"))
    points = F.aggregate(F.col("d.rooms"), F.lit(0), lambda a, r: a + F.size(r["ring"]))
    return d.groupBy("grp").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("d.rooms")).alias("rooms"), F.sum(points).alias("points"))


@register(f"""WITH {Q.ROOMS_SQL}, s AS (SELECT corpus, tag, count(*) AS n, round(quantile_cont(area_m2, 0.05), 2) AS area_p5, round(quantile_cont(short_m, 0.05), 2) AS width_p5 FROM r JOIN plans p ON p.plan_id = r.plan_id WHERE tag <> 'Unset' GROUP BY corpus, tag) SELECT corpus, tag, 1000 * n AS n, area_p5, width_p5 FROM s""")
def a12_percentile_report(spark, sf):
    """The statistics by corpus and tag as a Markdown report (counts in thousands with commas), and the dimension that is read from it."""
    rooms = Q._rooms(spark, sf).where("tag <> 'Unset'").join(table(spark, sf, "plans").select("plan_id", "corpus"), "plan_id")
    s = O.category_statistics(rooms, "corpus")
    cell = lambda c: F.format_string("%.2f", F.round(c, 2))
    names = ["area_p5", "area_p25", "area_p50", "area_p75", "area_p95", "width_p5", "width_p25", "width_p50"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "tag", F.format_number(F.col("n") * 1000, 0), *[cell(n) for n in names]), F.lit(" |"))
    heads = [(0, "## {}"), (1, ""), (2, "| RoomTag | n | area p5 | p25 | p50 | p75 | p95 | width p5 | p25 | p50 |"), (3, "|-|-|-|-|-|-|-|-|-|-|")]
    head = s.select("corpus").distinct().select("corpus", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in heads])).alias("h"))
    lines = head.select("corpus", "h.k", F.lit("").alias("tag"), F.replace("h.t", F.lit("{}"), F.col("corpus")).alias("value")).unionByName(s.select("corpus", F.lit(9).alias("k"), "tag", row.alias("value")))
    path = _folder(spark, "report")
    lines.coalesce(1).sortWithinPartitions("corpus", "k", "tag").select("value").write.text(path)
    read = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    return A.markdown_percentiles(read).select("corpus", "tag", "n", "area_p5", "width_p5")


@register(f"WITH {B}, floors AS (SELECT * FROM {D.floors_sql()}) SELECT f.kind, f.tag, CAST(f.compactness AS DOUBLE) AS compactness, CAST(f.prop_req AS DOUBLE) AS prop_req, count(p.plan_id) AS plans FROM floors f LEFT JOIN plans p ON p.kind = f.kind GROUP BY ALL")
def a14_floors_document(spark, sf):
    """The plan-level floors as one JSON document, read back, with the plans that each applies to."""
    path = _folder(spark, "floors")
    text = json.dumps({k: {"compactness": K.COMPACTNESS_FLOOR[k], "proportions": m} for k, m in K.PROPORTION_FLOOR.items()}, indent=1)
    spark.createDataFrame([(text,)], "value string").write.text(path)
    plans = table(spark, sf, "plans").groupBy("kind").agg(F.count(F.lit(1)).alias("plans"))
    return A.floors_of(spark, path).join(plans, "kind", "left").select("kind", "tag", "compactness", "prop_req", F.coalesce("plans", F.lit(0)).alias("plans"))


@register(f"WITH {Q.FEATURE_SQL} SELECT grp, kind, count(*) AS plans, CAST(sum(rooms) AS BIGINT) AS rooms, {q6('min(pp)', 'least_pp')} FROM pf GROUP BY grp, kind")
def a18_feature_cache(spark, sf):
    """Features computed once, written whole or not at all, and read again by group."""
    cached = stage(Q._features(spark, sf)[0], "features")
    return cached.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("plans"), F.sum("rooms").alias("rooms"), F.min("pp").alias("least_pp")).select("grp", "kind", "plans", "rooms", r6("least_pp"))


@register(f"WITH {B}, n AS (SELECT plan_id, count(*) FILTER (vix = 0) AS rooms FROM vertices GROUP BY plan_id) SELECT plan_id, CASE WHEN plan_id % 20 NOT BETWEEN 1 AND 9 THEN rooms END AS rooms, CASE plan_id % 20 " + " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in FAULTS.items() if k < 10) + " END AS failure FROM n")
def a19_failure_rows(spark, sf):
    """A row for each document: its rooms, or why it could not be read."""
    broken = _documents(spark, sf).withColumn("text", F.expr("CASE plan_id % 20 " + " ".join(f"WHEN {k} THEN {e}" for k, (_, e) in FAULTS.items() if k < 10) + " ELSE text END"))
    d = stage(A.validated(broken).select("plan_id", "reason", F.expr("size(try_variant_get(doc, '$.rooms', 'array<variant>'))").cast("long").alias("rooms")), "scan")
    return R.with_failures(d.where("reason IS NULL").select("plan_id", "rooms"), d.where("reason IS NOT NULL").select("plan_id", F.col("reason").alias("failure")), "plan_id")


@register(f"WITH {Q.BUILDING_SQL} SELECT floor_id, building FROM bld WHERE threshold = 0.4")
def a20_building_cache(spark, sf):
    """The building key at both thresholds in one partitioned table, looked up at the lower one."""
    path = _folder(spark, "buildings")
    Q._buildings(spark, sf).write.partitionBy("threshold").parquet(path)
    return spark.read.parquet(path).where("threshold = 0.4").select("floor_id", "building")


@register(f"""WITH {UNITS_SQL}, en AS (SELECT DISTINCT s.plan_id, m.unit_ix FROM (SELECT plan_id, a AS room_ix, b AS t FROM access WHERE kind = 'entrance' UNION ALL SELECT plan_id, b, a FROM access WHERE kind = 'entrance') s JOIN mem m ON m.plan_id = s.plan_id AND m.room_ix = s.room_ix JOIN mem o ON o.plan_id = s.plan_id AND o.room_ix = s.t WHERE m.unit_ix IS NOT NULL AND (o.unit_ix IS NULL OR o.unit_ix <> m.unit_ix)),
u AS (SELECT plan_id, unit_ix, count(*) AS n FROM mem WHERE unit_ix IS NOT NULL GROUP BY plan_id, unit_ix)
SELECT CAST(plan_id AS VARCHAR) AS id, count(*) AS rooms, NULL AS failure FROM mem GROUP BY plan_id UNION ALL
SELECT u.plan_id || '#u' || u.unit_ix, CASE WHEN en.unit_ix IS NOT NULL THEN n END, CASE WHEN en.unit_ix IS NULL THEN 'no-entry' END FROM u LEFT JOIN en ON en.plan_id = u.plan_id AND en.unit_ix = u.unit_ix""")
def a22_floors_and_apartments(spark, sf):
    """A row for each floor and each apartment; an apartment without an entrance is a failure of its own and leaves the others."""
    m = stage(Q._members(spark, sf), "members")
    floors = m.groupBy(F.col("plan_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("rooms"))
    unit = F.concat(F.col("plan_id").cast("string"), F.lit("#u"), F.col("unit_ix").cast("string")).alias("id")
    units = m.where("unit_ix IS NOT NULL").groupBy("plan_id", "unit_ix").agg(F.count(F.lit(1)).alias("rooms")).join(G.entry_rooms(m, table(spark, sf, "access")), ["plan_id", "unit_ix"], "left")
    read = units.where("entry_room IS NOT NULL").select(unit, "rooms")
    return R.with_failures(floors.unionByName(read), units.where("entry_room IS NULL").select(unit, F.lit("no-entry").alias("failure")), "id")


@register(f"WITH {B} SELECT plan_id, room_ix AS node, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 4 AS INTEGER) END AS zoning_type FROM rooms")
def a23_zoning(spark, sf):
    r = table(spark, sf, "rooms").select("plan_id", F.col("room_ix").alias("node"), "l_partkey")
    nodes = r.where("l_partkey % 5 <> 0").select("plan_id", "node", (F.col("l_partkey") % 4).cast("int").alias("zoning_type"))
    return R.zoning(r.select("plan_id", "node"), nodes)


@register(Q.ORACLES["c16_align"].replace("SELECT v.plan_id, room_ix, vix,", "SELECT v.plan_id, room_ix, vix, 0.0 AS pixel, NULL AS entry,"))
def a24_interiors(spark, sf):
    """Rooms on the floor's own axes as they are, without tiling: no entry, no pixel."""
    return Q.c16_align(spark, sf).select("*", F.lit(0.0).alias("pixel"), F.lit(None).cast("string").alias("entry"))


@register(f"""WITH w AS ({Q.ORACLES['d19_wall_gap']}), t AS ({Q.ORACLES['d20_edges_over_two']}), h AS ({Q.ORACLES['d21_shared_exact']})
SELECT t.plan_id, unnest(['wallGapM', 'edgesOverTwo', 'sharedExact']) AS name, unnest([q50, CAST(n AS DOUBLE), share]) AS value FROM t JOIN w ON w.plan_id = t.plan_id JOIN h ON h.plan_id = t.plan_id""")
def a25_floor_notes(spark, sf):
    """The measurements that a floor carries, as one map (D19, D20, D21)."""
    e = staged_edges(spark, sf)[0]
    gaps = V.wall_gaps(V.facing_pairs(e), table(spark, sf, "plans")).select("plan_id", r6("q50"))
    j = V.edges_over_two(e).join(gaps, "plan_id").join(V.shared_share(e).select("plan_id", r6("share")), "plan_id")
    notes = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.col(c).cast("double").alias("v")) for n, c in (("wallGapM", "q50"), ("edgesOverTwo", "n"), ("sharedExact", "share"))]))
    return j.select("plan_id", notes.alias("notes")).select("plan_id", F.explode("notes").alias("name", "value"))


@register(f"""WITH {UNITS_SQL}, u AS (SELECT plan_id, greatest(count(DISTINCT unit_ix), 1) AS n FROM mem GROUP BY plan_id) SELECT plan_id, x.name, x.kind FROM u, (VALUES ('corridorExposure', 'refused', TRUE), ('demisingExposure', 'refused', TRUE), ('areaProgram', 'not transferable', FALSE)) AS x(name, kind, exposure) WHERE n < 2 OR NOT exposure""")
def b12_scope_notes(spark, sf):
    """What a plan cannot be graded on: the exposure checks with fewer than two apartments, the area program always."""
    n = Q._members(spark, sf).groupBy("plan_id").agg(F.countDistinct("unit_ix").alias("units"))
    return n.select("plan_id", F.explode(D.scope_notes(F.col("units"))).alias("x")).select("plan_id", "x.name", "x.kind")


@register(f"WITH {B} SELECT DISTINCT 'corpus' AS what, corpus AS name, TRUE AS known FROM plans UNION SELECT DISTINCT 'kind', kind, TRUE FROM plans UNION SELECT DISTINCT 'check', category, FALSE FROM rooms UNION SELECT 'source', grp, FALSE FROM plans")
def b15_known_names(spark, sf):
    """Names of each sort that the tables hold, and whether the engine knows them; an unknown one is an error before any row is read."""
    p, r = table(spark, sf, "plans"), table(spark, sf, "rooms")
    names = p.select(F.lit("corpus").alias("what"), F.col("corpus").alias("name")).union(p.select(F.lit("kind"), "kind")).union(r.select(F.lit("check"), "category")).union(p.select(F.lit("source"), "grp")).distinct()
    return names.withColumn("known", D.is_known(F.col("what"), F.col("name")))


@register(f"""WITH {UNITS_SQL}, loc AS (SELECT plan_id, unit_ix, room_ix, category, row_number() OVER (PARTITION BY plan_id, unit_ix ORDER BY room_ix) - 1 AS i FROM mem WHERE unit_ix IS NOT NULL),
s AS (SELECT plan_id, a AS room_ix, b AS o FROM access UNION ALL SELECT plan_id, b, a FROM access),
w AS (SELECT l.plan_id, l.unit_ix, l.room_ix, s.o AS other, CASE WHEN q.unit_ix = l.unit_ix THEN t.i WHEN q.unit_ix IS NULL THEN -2 ELSE -3 END AS owner, q.category IN ('corridor', 'stairs') AS circ FROM loc l JOIN s ON s.plan_id = l.plan_id AND s.room_ix = l.room_ix JOIN mem q ON q.plan_id = s.plan_id AND q.room_ix = s.o LEFT JOIN loc t ON t.plan_id = s.plan_id AND t.room_ix = s.o AND t.unit_ix = l.unit_ix UNION ALL SELECT plan_id, unit_ix, room_ix, -1, -1, FALSE FROM loc)
SELECT plan_id, unit_ix, room_ix, CAST(other AS INTEGER) AS other, CASE WHEN owner >= 0 AND circ THEN owner || ',-4' ELSE CAST(owner AS VARCHAR) END AS exposure, CAST(CASE WHEN owner >= 0 AND circ THEN -4 WHEN owner < 0 THEN owner ELSE 0 END AS INTEGER) AS code FROM w""")
def f08_exposure_codes(spark, sf):
    """The exposure list and class of each wall of an apartment's rooms, by what is on its other side."""
    e = _exposures(spark, sf)
    return e.select("plan_id", "unit_ix", "room_ix", "other", F.array_join(F.col("exposure").cast("array<string>"), ",").alias("exposure"), G.code_of(F.col("exposure")).alias("code"))


def _exposures(spark, sf):
    m = stage(Q._members(spark, sf), "members")
    local = G.unit_views(m, table(spark, sf, "access"))[0]
    a = table(spark, sf, "access")
    sides = a.select("plan_id", F.col("a").alias("room_ix"), F.col("b").alias("other")).union(a.select("plan_id", "b", "a"))
    own = local.select("plan_id", "unit_ix", "room_ix")
    across = m.select("plan_id", F.col("room_ix").alias("other"), F.col("unit_ix").alias("its"), F.col("category").isin(*G.CIRCULATION).alias("circulating"))
    t = local.select("plan_id", F.col("room_ix").alias("other"), F.col("local_ix"))
    w = own.join(sides, ["plan_id", "room_ix"]).join(across, ["plan_id", "other"]).join(t, ["plan_id", "other"], "left")
    owner = F.when(F.col("its") == F.col("unit_ix"), F.col("local_ix")).when(F.col("its").isNull(), K.EXPOSURE["corridor"]).otherwise(K.EXPOSURE["demising"])
    walls = w.select("plan_id", "unit_ix", "room_ix", "other", owner.alias("owner"), "circulating").unionByName(own.select("*", F.lit(-1).alias("other"), F.lit(K.EXPOSURE["exterior"]).alias("owner"), F.lit(False).alias("circulating")))
    return walls.withColumn("exposure", G.encode(F.col("owner"), F.col("circulating")))


@register(f"""WITH {UNITS_SQL}, loc AS (SELECT plan_id, unit_ix, room_ix FROM mem WHERE unit_ix IS NOT NULL) SELECT plan_id, unit_ix, room_ix, CASE plan_id % 7 WHEN 0 THEN '' WHEN 1 THEN '99' ELSE '-5' END AS exposure FROM loc WHERE plan_id % 7 < 3""")
def f10_unreadable_exposure(spark, sf):
    """Walls whose exposure says nothing readable: an empty list, an index beyond the apartment's rooms, a code that does not exist (put into some plans' outer walls)."""
    e = _exposures(spark, sf)
    n = e.where("other = -1").groupBy("plan_id", "unit_ix").agg(F.count(F.lit(1)).alias("rooms"))
    bad = F.when(F.col("plan_id") % 7 == 0, F.array().cast("array<int>")).when(F.col("plan_id") % 7 == 1, F.array(F.lit(99))).when(F.col("plan_id") % 7 == 2, F.array(F.lit(-5)))
    e = e.withColumn("exposure", F.when(F.col("other") == -1, F.coalesce(bad, F.col("exposure"))).otherwise(F.col("exposure"))).join(n, ["plan_id", "unit_ix"])
    return e.where(G.unreadable(F.col("exposure"), F.col("rooms"))).select("plan_id", "unit_ix", "room_ix", F.array_join(F.col("exposure").cast("array<string>"), ",").alias("exposure"))


@register(f"WITH {Q.CELLS_SQL}, o AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{g}{chr(39)}, {i})' for i, (g, _, _) in enumerate(K.GROUPS))}) AS x(grp, place)) SELECT CAST(place AS INTEGER) AS place, rt.grp, denominator, round(100 * passed / CAST(total AS DOUBLE) + 1e-9, 6) AS rate FROM rt JOIN o ON o.grp = rt.grp WHERE total > 0")
def g05_rate_table(spark, sf):
    """Rates in the groups' report order, cells without a total left out."""
    t = O.with_wilson(O.rates(O.outcomes(Q._events(spark, sf)))).where("rate IS NOT NULL")
    return t.join(F.broadcast(D.groups(spark).select("grp", "place")), "grp").select("place", "grp", "denominator", r6("rate"))


BUILDING_EVENTS = Q.CLUSTER_SQL.replace("user_id AS cluster", "CASE WHEN event_type = 'view' THEN user_id % 40 ELSE user_id END AS cluster")


@register(f"""WITH {BUILDING_EVENTS}, x AS (SELECT replicate, 'graded' AS denominator, grp, 100 * passed / CAST(graded AS DOUBLE) AS rate FROM rp UNION ALL SELECT replicate, 'admitted', grp, 100 * passed / CAST(admitted AS DOUBLE) FROM rp WHERE admitted > 0 UNION ALL SELECT replicate, 'verdict', grp, 100 * passed / CAST(verdict AS DOUBLE) FROM rp WHERE verdict > 0),
mg AS (SELECT replicate, denominator, min(CASE WHEN role = 'truth' THEN rate END) - max(CASE WHEN role = 'baseline' THEN rate END) AS margin FROM x JOIN roles ON roles.grp = x.grp GROUP BY replicate, denominator),
ci AS (SELECT denominator, round(quantile_cont(margin, 0.025) + 1e-9, 6) AS low, round(quantile_cont(margin, 0.975) + 1e-9, 6) AS high FROM mg GROUP BY denominator)
SELECT sz.grp, sz.c AS clusters, ci.denominator, low, high FROM sz, ci""")
def g22_building_margin(spark, sf):
    """The margin with buildings resampled whole, re-selected in every replicate, and the clusters of each group."""
    e = Q._events(spark, sf).withColumn("cluster", F.when(F.col("grp") == "msd units", F.col("cluster") % 40).otherwise(F.col("cluster")))
    totals = stage(O.cluster_totals(e), "clusters")
    low_high = O.interval(O.replicate_margins(O.cluster_replicates(totals, Q.REPLICATES), D.groups(spark)), "margin", "denominator")
    n = totals.groupBy("grp").agg(F.count(F.lit(1)).alias("clusters"))
    return n.crossJoin(F.broadcast(low_high)).select("grp", "clusters", "denominator", r6("low"), r6("high"))


@register(f"WITH {UNITS_SQL}, n AS (SELECT plan_id, count(DISTINCT unit_ix) AS u FROM mem GROUP BY plan_id) SELECT p.plan_id, CASE WHEN corpus <> 'msd' THEN 'rplan' WHEN u > 1 THEN 'msd-floor' ELSE 'msd-unit' END AS kind FROM plans p JOIN n ON n.plan_id = p.plan_id")
def i02_raw_kind(spark, sf):
    """The kind of documents that no model reads (their rings are text), from the unit labels of their rooms."""
    m = G.unit_labels(Q._members(spark, sf))
    text = F.to_json(F.struct(F.collect_list(F.struct("unit", F.lit("broken").alias("ring"))).alias("rooms"))).alias("text")
    d = A.parsed(m.groupBy("plan_id").agg(text)).join(table(spark, sf, "plans").select("plan_id", "corpus"), "plan_id")
    return d.select("plan_id", D.floor_kind(F.col("corpus"), A.raw_units(F.col("doc"))).alias("kind"))


@register(f"""WITH {Q.ROOMS_SQL}, wr AS (SELECT plan_id, min(round(pp, 6)) AS pp, arg_min(room_ix, (round(pp, 6), room_ix)) AS room FROM r WHERE tag <> 'Hallway' GROUP BY plan_id), rc AS ({Q.ORACLES['c14_rectangularity']}) SELECT wr.plan_id, {q6('pp')}, room, rect FROM wr JOIN rc ON rc.plan_id = wr.plan_id AND rc.room_ix = wr.room""")
def i03_worst_room(spark, sf):
    """The least compact room of each plan that is no hallway, with its rectangularity."""
    from plangauge.operators import calibration as C

    e = staged_edges(spark, sf)[0]
    worst = C.plan_features(M.room_measures(e)).where("pp IS NOT NULL").withColumnRenamed("worst_room", "room_ix")
    only = e.join(worst.select("plan_id", "room_ix"), ["plan_id", "room_ix"], "left_semi")
    return worst.join(M.rectangularity(only), ["plan_id", "room_ix"]).select("plan_id", r6("pp"), F.col("room_ix").alias("room"), r6("rect"))


@register(f"WITH {Q.FEATURE_SQL} SELECT plan_id, grp, rooms FROM pf WHERE kind = 'rplan' AND grp IN ('rplan', 'msd units')")
def i04_kind_view(spark, sf):
    """Plans of one kind from all groups of real plans."""
    real = [g for g, _, r in K.GROUPS if r == "truth"]
    return Q._features(spark, sf)[0].where((F.col("kind") == "rplan") & F.col("grp").isin(*real)).select("plan_id", "grp", "rooms")


@register(f"WITH {Q.FIT2_SQL}{Q.FIT3_SQL[len(Q.FEATURE_SQL):]} SELECT a.kind, a.level, {q6('compactness')}, {q6('p')} FROM fit2 a JOIN fit3 b ON b.kind = a.kind AND b.level = a.level")
def i10_fit_both(spark, sf):
    """Both thresholds of every kind at every level."""
    from plangauge.operators import calibration as C

    pf, rf = (stage(x, "features") for x in Q._features(spark, sf))
    levels = Q._levels(spark)
    return C.fit_rung2(pf, levels, "kind").join(C.fit_rung3(pf, rf, levels, "kind"), ["kind", "level"]).select("kind", "level", r6("compactness"), r6("p"))


@register(f"WITH {Q.FEATURE_SQL}, k AS (SELECT DISTINCT kind FROM pf), x AS (SELECT kind, unnest([0, 5, 99]) AS least_rooms FROM k) SELECT x.kind, CAST(x.least_rooms AS INTEGER) AS least_rooms, CASE WHEN count(pf.plan_id) > 0 THEN round(count(*) FILTER (pf.pp < 0.5) / CAST(count(pf.plan_id) AS DOUBLE) + 1e-9, 6) END AS rate FROM x LEFT JOIN pf ON pf.kind = x.kind AND pf.rooms >= x.least_rooms GROUP BY x.kind, x.least_rooms")
def i11_rate_over_mask(spark, sf):
    """The share of plans under a compactness of 0.5 among those with so many rooms; null where there are none."""
    pf = Q._features(spark, sf)[0]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("least_rooms"), (F.col("rooms") >= k).alias("mask")) for k in (0, 5, 99)])).alias("m")
    rate = F.try_divide(F.count_if(F.col("mask") & F.coalesce(F.col("pp") < 0.5, F.lit(False))), F.count_if("mask"))
    return pf.select("kind", "pp", each).select("kind", "pp", "m.*").groupBy("kind", "least_rooms").agg(rate.alias("rate")).select("kind", "least_rooms", r6("rate"))
