"""Sample records in JSON lines, coded records, manifests' books, and what is looked up for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "struct<sample_id: bigint, units_per_metre: double, rooms: array<struct<category: string, node_index: int, ring: array<array<double>>>>, access: array<struct<a: int, b: int, kind: string>>>"
BOOK = "struct<written: bigint, samples_per_bucket: map<string, bigint>, checkpoints: map<string, struct<sha256: string>>, checkpoint: string, checkpoint_sha256: string>"

# The names of room codes, by data set, in the order of the codes from 0.
CODES = {
    "rplan": ("livingroom", "masterroom", "kitchen", "bathroom", "diningroom", "childroom", "studyroom", "secondroom", "guestroom", "balcony", "entrance", "storage", "walkin_closet"),
    "msd": ("bedroom", "livingroom", "kitchen", "dining", "corridor", "stairs", "storeroom", "bathroom", "balcony"),
}


def write_lines(rows: DataFrame, path: str, shard: str, *order: str) -> None:
    """Text `value` of rows as lines, one folder for each shard, lines in order within it (file names follow the order)."""
    rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order).select(shard, "value").write.partitionBy(shard).text(path)


def read_lines(spark: SparkSession, path: str, shard: str, limit: int | None = None) -> DataFrame:
    """(shard, value) of all lines that are not blank, in the order of shards, files and lines where a limit asks for the first ones."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    lines = lines.select(F.regexp_extract(F.col("_metadata.file_path"), f"{shard}=([^/]*)", 1).cast("long").alias(shard), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")
    lines = lines.where(F.trim("value") != "")
    if limit is not None:
        lines = lines.orderBy(shard, "_file", "_block", "_line").limit(limit)
    return lines.select(shard, "value")


def sample_records(lines: DataFrame) -> DataFrame:
    """The records of JSON lines: sample_id, units_per_metre, rooms, access."""
    return lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def _closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def usable(records: DataFrame) -> DataFrame:
    """records with only rooms whose ring has three points or more, closing repeats dropped, and access links between such rooms' places; plus `refusal`."""
    rooms = F.filter(F.transform(F.coalesce("rooms", F.array()), lambda r: r.withField("ring", _closed(r["ring"]))), lambda r: F.coalesce(F.size(r["ring"]) >= 3, F.lit(False)))
    r = records.withColumn("rooms", rooms)
    n = F.size("rooms")
    r = r.withColumn("access", F.filter(F.coalesce("access", F.array()), lambda e: (e["a"] != e["b"]) & (e["a"] >= 0) & (e["b"] >= 0) & (e["a"] < n) & (e["b"] < n)))
    return r.withColumn("pixel", F.try_divide(F.lit(1.0), F.col("units_per_metre"))).withColumn("refusal", F.when(n == 0, "no-usable-room"))


def record_vertices(records: DataFrame) -> DataFrame:
    """(plan_id, room_ix, category, vix, x, y) of usable records, rings counter-clockwise."""
    r = records.where("refusal IS NULL").select(F.col("sample_id").alias("plan_id"), F.posexplode("rooms").alias("room_ix", "r"))
    ring = F.col("r.ring")
    after = lambda i: ring[(i + 1) % F.size(ring)]
    area = F.aggregate(F.transform(ring, lambda p, i: p[0] * after(i)[1] - after(i)[0] * p[1]), F.lit(0.0), lambda a, x: a + x)
    v = r.select("plan_id", "room_ix", F.col("r.category").alias("category"), F.posexplode(F.when(area < 0, F.reverse(ring)).otherwise(ring)).alias("vix", "p"))
    return v.select("plan_id", "room_ix", "category", "vix", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose sample_id is among ids (one column of that name)."""
    return records.join(ids, "sample_id", "left_semi")


def sample_total(book: Column) -> Column:
    """Samples that a book says were written, in either spelling."""
    per = F.aggregate(F.map_values(book["samples_per_bucket"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(book["written"], F.when(F.size(book["samples_per_bucket"]) > 0, per))


def checkpoints(book: Column) -> Column:
    """Array of (role, sha256) of a book's checkpoints by role, or of its one checkpoint; empty where it states none."""
    several = F.transform(F.array_sort(F.map_keys(book["checkpoints"])), lambda k: F.struct(k.alias("role"), F.coalesce(F.element_at(book["checkpoints"], k)["sha256"], F.lit("unknown")).alias("sha256")))
    single = F.array(F.struct(book["checkpoint"].alias("role"), F.coalesce(book["checkpoint_sha256"], F.lit("unknown")).alias("sha256")))
    return F.when(F.size(book["checkpoints"]) > 0, several).when(book["checkpoint"] != "", single).otherwise(F.array().cast("array<struct<role: string, sha256: string>>"))


def category_of(dataset: str, code: Column) -> Column:
    """The name of a data set's room code; codes that are not known are named by their number."""
    names = F.array(*[F.lit(n) for n in CODES[dataset]])
    known = F.get(names, F.when(code >= 0, code.cast("int")))
    return F.coalesce(known, F.concat(F.lit(f"{dataset}_unknown_"), F.coalesce(code.cast("string"), F.lit("none"))))


def category_sql(dataset: str, code: str) -> str:
    return f"CASE CAST({code} AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CODES[dataset])) + f" ELSE '{dataset}_unknown_' || {code} END"


def entry_from_boundary(rows: DataFrame) -> DataFrame:
    """(plan_id, x, y): the midpoint of a plan's first two boundary rows (at, x, y, flag) flagged 1; null where there are fewer."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("flag") == 1, F.struct("at", "x", "y")))), 1, 2)
    two = rows.groupBy("plan_id").agg(first.alias("m"))
    mid = lambda c: F.when(F.size("m") == 2, (F.col("m")[0][c] + F.col("m")[1][c]) / 2.0)
    return two.select("plan_id", mid("x").alias("x"), mid("y").alias("y"))


def coded_access(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """edges (plan_id, a, b, code) between two different rooms of the plan; rooms (plan_id, rooms) counts them. The code is carried in the kind, unread."""
    e = edges.join(rooms.select("plan_id", "rooms"), "plan_id").where("a <> b AND a >= 0 AND b >= 0 AND a < rooms AND b < rooms")
    return e.select("plan_id", "a", "b", F.concat(F.lit("rplan_edge_unknown_"), F.col("code").cast("string")).alias("kind"))


def with_failures(parsed: DataFrame, failed: DataFrame, *keys: str) -> DataFrame:
    """One outcome row for each input: parsed rows, and failed ones with their reason as `failure`, so that no failure ends the scan."""
    return parsed.withColumn("failure", F.lit(None).cast("string")).unionByName(failed.select(*keys, "failure"), allowMissingColumns=True)


def zoning(rooms: DataFrame, nodes: DataFrame) -> DataFrame:
    """rooms (plan_id, node) plus the zoning_type of the floor's node of that id, null where it is missing."""
    return rooms.join(nodes.select("plan_id", "node", "zoning_type"), ["plan_id", "node"], "left")


def numbered(rows: DataFrame, *keys: str, order: str, name: str) -> DataFrame:
    """rows plus `name`, their place from 0 within a plan's keys."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))
