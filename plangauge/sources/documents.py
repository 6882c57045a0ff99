"""Plan documents: reading and validating JSON, writing it, manifests, samples. All of it is column work on whole rows; nothing shuffles but joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core import constants as K

# Run group to source token.
SOURCE_TOKENS = {"rplan": "rplan", "msd": "msd", "msd units": "msd", "houseganpp": "houseganpp", "housegan": "housegan", "gsdiff": "gsdiff", "housediffusion": "housediffusion"}

_KIND = lambda v: f"coalesce(schema_of_variant({v}), 'MISSING')"
_OBJECT = lambda v: f"try_variant_get({v}, '$', 'map<string, variant>')"
_ITEMS = lambda v: f"try_variant_get({v}, '$', 'array<variant>')"
_NUMBER = lambda v: f"if({_KIND(v)} = 'BOOLEAN', 0D, try_cast(try_variant_get({v}, '$', 'string') AS DOUBLE))"
_LET = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"


def _point_fault(p: str) -> str:
    """SQL for the fault of one point: not a pair of numbers, or not finite."""
    bad = lambda x: f"isnan({x}) OR abs({x}) = double('Infinity')"
    numbers = f"CASE WHEN n.x IS NULL OR n.y IS NULL THEN 'malformed-point' WHEN {bad('n.x')} OR {bad('n.y')} THEN 'non-finite-coordinate' END"
    return _LET("xy", _ITEMS(p), f"CASE WHEN xy IS NULL OR size(xy) <> 2 THEN 'malformed-point' ELSE {_LET('n', f'struct({_NUMBER('xy[0]')} AS x, {_NUMBER('xy[1]')} AS y)', numbers)} END")


def _ring_fault(r: str) -> str:
    """SQL for the fault of one ring. A ring that reads as pairs of finite numbers, four or more, has none; others are looked at point by point."""
    finite = lambda k: f"coalesce(abs(get(p, {k})) < double('Infinity'), false)"
    sound = _LET("d", f"try_variant_get({r}, '$', 'array<array<double>>')", f"coalesce(size(d) >= 4 AND forall(d, p -> coalesce(size(p) = 2, false) AND {finite(0)} AND {finite(1)}), false)")
    faults = f"filter(transform(pts, p -> {_point_fault('p')}), f -> f IS NOT NULL)"
    closes = "to_json(pts[0]) = to_json(pts[size(pts) - 1]) AND size(pts) >= 2"
    nested = f"{_KIND(f'get({_ITEMS("pts[0]")}, 0)')} LIKE 'ARRAY%'"
    by_point = f"""CASE WHEN pts IS NULL THEN if({_KIND(r)} LIKE 'OBJECT%', 'room-with-hole', 'malformed-ring') WHEN size(pts) = 0 THEN 'malformed-ring'
      WHEN {nested} THEN 'room-with-hole' ELSE {_LET('bad', faults, f"CASE WHEN size(bad) > 0 THEN bad[0] WHEN size(pts) - if({closes}, 1, 0) < 3 THEN 'malformed-ring' END")} END"""
    return f"CASE WHEN NOT {sound} THEN {_LET('pts', _ITEMS(r), by_point)} END"


def _room_fault(r: str) -> str:
    get = lambda k: f"try_variant_get({r}, '$.{k}', 'variant')"
    unit = f"CASE WHEN {get('unit')} IS NOT NULL AND {_KIND(get('unit'))} NOT IN ('STRING', 'VOID') THEN 'malformed-room' END"
    return f"""CASE WHEN {_OBJECT(r)} IS NULL THEN 'malformed-room' WHEN {_KIND(get('category'))} <> 'STRING' OR try_variant_get({r}, '$.category', 'string') = '' THEN 'missing-category'
      WHEN {get('holes')} IS NOT NULL OR {get('interiors')} IS NOT NULL THEN 'room-with-hole' ELSE {_LET('ring', get('ring'), f"coalesce({_ring_fault('ring')}, {unit})")} END"""


def parsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus `doc` (variant; null if the text is not JSON). Bare NaN and Infinity are quoted first, so that they can be told from broken JSON.

    doc comes from a generator, so that a filter on what is made of it does not parse the text again for each place that names it.
    """
    text = F.col(text_col)
    quoted = F.regexp_replace(text, r"(?<=[\[,:\s])(-?Infinity|NaN)(?=[\],}\s])", '"$1"')
    bare = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    return docs.select("*", F.explode(F.array(F.try_parse_json(F.when(bare, quoted).otherwise(text)))).alias("doc"))


def validated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """parsed(docs) plus `reason`: the first fault in the fixed order of checks, null for an accepted document, and the `room` it lies in. Both are worked out once, in a generator."""
    rooms = "try_variant_get(doc, '$.rooms', 'array<variant>')"
    faults = f"filter(transform(rooms, (r, i) -> struct(i AS room, {_room_fault('r')} AS fault)), x -> x.fault IS NOT NULL)"
    ends = ", ".join(f"try_variant_get(e, '$[{k}]', 'bigint') AS {n}" for k, n in enumerate("ab"))
    apart = "m.a IS NULL OR m.b IS NULL OR m.a NOT BETWEEN 0 AND size(rooms) - 1 OR m.b NOT BETWEEN 0 AND size(rooms) - 1 OR m.a = m.b"
    pair = f"{_LET('e2', _ITEMS('e'), 'e2 IS NULL OR size(e2) <> 2')} OR {_LET('m', f'struct({ends})', apart)}"
    source, meta = "try_variant_get(doc, '$.source', 'variant')", "try_variant_get(doc, '$.meta', 'variant')"
    reason = f"""CASE WHEN doc IS NULL THEN 'malformed-json' WHEN {_OBJECT('doc')} IS NULL THEN 'malformed-plan' WHEN rooms IS NULL OR size(rooms) = 0 THEN 'no-rooms'
      WHEN size(faults) > 0 THEN faults[0].fault WHEN {_KIND(source)} <> 'STRING' OR try_variant_get(doc, '$.source', 'string') = '' THEN 'missing-source'
      WHEN exists(coalesce(try_variant_get(doc, '$.adjacency', 'array<variant>'), array()), e -> {pair}) THEN 'malformed-adjacency'
      WHEN {meta} IS NOT NULL AND {_OBJECT(meta)} IS NULL AND {_KIND(meta)} <> 'VOID' THEN 'malformed-plan' END"""
    found = _LET("rooms", rooms, _LET("faults", faults, f"struct({reason} AS reason, if(size(faults) > 0, faults[0].room, null) AS room)"))
    return parsed(docs, text_col).select("*", F.expr(f"inline(array({found}))"))


def rooms_of(accepted: DataFrame, *keys: str) -> DataFrame:
    """keys, room_ix, category, unit, vix, x, y of accepted documents; the closing repeat of a ring is dropped.

    Arrays are exploded with their empty rows, which go afterwards: no filter on their size, which would read them twice, is put before that.
    """
    r = accepted.select(*keys, F.expr("posexplode_outer(variant_get(doc, '$.rooms', 'array<variant>'))").alias("room_ix", "r")).where("room_ix IS NOT NULL")
    open_ = _LET("g", "variant_get(r, '$.ring', 'array<array<double>>')", "if(size(g) > 1 AND g[0] = g[size(g) - 1], slice(g, 1, size(g) - 1), g)")
    r = r.select(*keys, "room_ix", F.expr("variant_get(r, '$.category', 'string')").alias("category"), F.expr("try_variant_get(r, '$.unit', 'string')").alias("unit"), F.expr(f"posexplode_outer({open_})").alias("vix", "p"))
    return r.where("vix IS NOT NULL").select(*keys, "room_ix", "category", "unit", "vix", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def adjacency_of(accepted: DataFrame, *keys: str) -> DataFrame:
    """keys, place, a, b: distinct pairs a < b in the order in which they first occur."""
    e = accepted.select(*keys, F.expr("posexplode_outer(try_variant_get(doc, '$.adjacency', 'array<array<bigint>>'))").alias("at", "p")).where("at IS NOT NULL")
    e = e.select(*keys, "at", F.least(F.col("p")[0], F.col("p")[1]).alias("a"), F.greatest(F.col("p")[0], F.col("p")[1]).alias("b")).groupBy(*keys, "a", "b").agg(F.min("at").alias("at"))
    return e.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).alias("place"), "a", "b")


def as_documents(vertices: DataFrame, plans: DataFrame, access: DataFrame) -> DataFrame:
    """(plan_id, grp, text): one JSON document for each plan, coordinates in metres."""
    xy = F.array((F.col("ix") * K.STEP_M).alias("x"), (F.col("iy") * K.STEP_M).alias("y"))
    rings = vertices.groupBy("plan_id", "room_ix", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("vix", xy.alias("p")))), lambda v: v["p"]).alias("ring"))
    rooms = rings.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("room_ix", "category", "ring"))), lambda r: F.struct(r["category"].alias("category"), r["ring"].alias("ring"))).alias("rooms"))
    links = access.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_ix", F.array("a", "b").alias("p")))), lambda e: e["p"]).alias("adjacency"))
    d = plans.join(rooms, "plan_id").join(links, "plan_id", "left")
    meta = F.struct(F.col("pixel").alias("sourcePixelM"), F.col("grp").alias("group"), "corpus")
    body = F.struct(F.col("plan_id").cast("string").alias("name"), source_token(F.col("grp")).alias("source"), "rooms", F.coalesce("adjacency", F.array().cast("array<array<int>>")).alias("adjacency"), meta.alias("meta"))
    return d.select("plan_id", "grp", F.to_json(body).alias("text"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One folder of JSON lines for each group; the committer makes the write whole or nothing."""
    docs.select("grp", F.col("text").alias("value")).write.partitionBy("grp").text(path)


def read_corpus(spark, path: str) -> DataFrame:
    """(grp, stem, text) of every file under path, one document a file, the group being the folder's name."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    name = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("grp"), F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("stem"), F.col("value").alias("text"))


def source_token(group: Column) -> Column:
    """The source a group's documents name; a group that is not known is its own."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_TOKENS.items() for x in kv])
    return F.coalesce(F.element_at(known, group), group)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._#-]", "_")


def last_component(path: Column) -> Column:
    """The last part of a path with slashes of either kind."""
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def corpus_of(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """docs (directory, meta_group, meta_corpus) plus group and corpus: stated in the document, else in the manifest, else from the directory. manifest is small."""
    m = manifest.select(last_component(F.col("directory")).alias("directory"), F.col("group").alias("m_group"), F.col("corpus").alias("m_corpus"))
    d = docs.join(F.broadcast(m), "directory", "left")
    grp = F.coalesce("meta_group", "m_group", "directory")
    return d.withColumn("group", grp).withColumn("corpus", F.coalesce("meta_corpus", "m_corpus", F.when(grp.startswith("msd"), "msd").otherwise("rplan"))).drop("m_group", "m_corpus")


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(place, group, written, directory): new entries replace old ones of their group in place, new groups follow in their own order."""
    o = old.select("group", F.col("place").alias("op"), F.col("written").alias("ow"), F.col("directory").alias("od"))
    n = new.select("group", F.col("place").alias("np"), F.col("written").alias("nw"), F.col("directory").alias("nd"))
    j = o.join(n, "group", "full_outer")
    w = Window.orderBy(F.col("op").asc_nulls_last(), "np")
    return j.select((F.row_number().over(w) - 1).alias("place"), "group", F.coalesce("nw", "ow").alias("written"), F.coalesce("nd", "od").alias("directory"))


def systematic_sample(rows: DataFrame, order: str, stride: int, offset: int, limit: int) -> DataFrame:
    """Every stride-th row from offset on, limit rows at most; row numbers come from a range-partitioned sort, not from one task.

    Partition sizes (one number each) give each partition's first row number.
    """
    part = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    inside = part.withColumn("_k", F.row_number().over(w) - 1)
    sizes = inside.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    firsts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    at = inside.join(F.broadcast(firsts), "_p").withColumn("ix", F.col("_k") + F.col("_f"))
    return at.where(f"ix >= {offset} AND (ix - {offset}) % {max(stride, 1)} = 0 AND ix < {offset} + {limit} * {max(stride, 1)}").drop("_p", "_k", "_f")


def floors_of(spark, path: str) -> DataFrame:
    """(kind, compactness, tag, prop_req) from one JSON document of floors by kind; the document is small."""
    text = spark.read.text(path, wholetext=True)
    kinds = text.select(F.explode(F.from_json("value", "map<string, struct<compactness: double, proportions: map<string, double>>>")).alias("kind", "f"))
    return kinds.select("kind", F.col("f.compactness").alias("compactness"), F.explode("f.proportions").alias("tag", "prop_req"))


def raw_units(doc: Column) -> Column:
    """How many different unit labels the rooms of a document (variant) carry, whatever else is wrong with it."""
    rooms = F.coalesce(F.try_variant_get(doc, "$.rooms", "array<variant>"), F.array().cast("array<variant>"))
    return F.size(F.array_distinct(F.filter(F.transform(rooms, lambda r: F.try_variant_get(r, "$.unit", "string")), lambda u: u.isNotNull())))


def markdown_percentiles(lines: DataFrame) -> DataFrame:
    """(corpus, tag, n, area_p5, width_p5) from the lines (at, value) of a Markdown report: columns 0, 1, 2 and 7 of its RoomTag tables.

    A heading holds for the rows below it until the next one; thousands commas are tolerated; the report is one small document.
    """
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("corpus", F.last(F.when(F.col("value").rlike("^## "), F.trim(F.expr("substring(value, 4)"))), ignorenulls=True).over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.col("value")), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    s = s.where("value LIKE '|%'").withColumn("c", cells).withColumn("head", F.last(F.when(F.col("value").rlike(r"^\|\s*[A-Za-z]") & F.array_contains(cells, "area p5"), F.col("c")[0]).when(F.col("value").rlike(r"^\|\s*p0"), F.lit("p")), ignorenulls=True).over(w))
    num = lambda k: F.regexp_replace(F.get("c", F.lit(k)), ",", "").try_cast("double")
    return s.where("head = 'RoomTag'").select("corpus", F.col("c")[0].alias("tag"), num(1).cast("long").alias("n"), num(2).alias("area_p5"), num(7).alias("width_p5")).where("n IS NOT NULL")
