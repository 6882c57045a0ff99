"""Plans, rooms and access links derived from star-schema tables: an order is a plan, a line item a room.

Coordinates are integer lattice steps. The rooms of a plan stand in a row, some with gaps or overlaps, in four shapes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from plangauge.core.constants import GROUPS
from plangauge.core.staging import stage_by

#: Line items (rooms) of one part of the derived tables: at most, on average; and at least, where there are fewer than the session's shuffle partitions.
MOST, LEAST = 50_000, 5_000
#: What rows take in a task's memory over what they take in the files: 36 bytes and more for under two, in narrow tables of plans.
UNPACKED = 30


def ctes(lineitem: str = "lineitem", orders: str = "orders") -> str:
    """The derivation as common table expressions (plans, rooms, vertices, edges, access) that any SQL engine can run."""
    return f"""
shape_vertices AS (
  SELECT * FROM (VALUES
   ('rect',0,0,0,0,1),('rect',1,2,0,0,1),('rect',2,2,0,1,1),('rect',3,0,0,1,1),
   ('ell',0,0,0,0,1),('ell',1,2,0,0,1),('ell',2,2,0,1,1),('ell',3,1,0,1,1),('ell',4,1,0,2,3),('ell',5,0,0,2,3),
   ('u',0,0,0,0,1),('u',1,2,0,0,1),('u',2,2,0,1,4),('u',3,2,-4,1,4),('u',4,2,-4,1,2),('u',5,2,0,1,2),('u',6,2,0,1,1),('u',7,0,0,1,1),
   ('skew',0,0,0,0,1),('skew',1,2,0,0,1),('skew',2,2,0,1,1),('skew',3,0,5,1,1)) AS t(shape, vix, fx, dx, fyn, fyd)),
numbered AS (
  SELECT l_orderkey AS plan_id, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS INT) AS room_ix,
    CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'bedroom' WHEN 'AO' THEN 'livingroom' WHEN 'NF' THEN 'kitchen' WHEN 'NO' THEN 'bathroom' WHEN 'RF' THEN 'corridor' ELSE 'balcony' END AS category,
    8 + l_partkey % 90 AS w, 50 + l_suppkey % 70 AS h,
    CASE WHEN l_partkey % 23 = 0 THEN 2 WHEN l_partkey % 23 = 1 THEN 12 WHEN l_partkey % 23 = 2 THEN -3 ELSE 0 END AS gap,
    CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 'ell' WHEN 1 THEN 'u' WHEN 2 THEN 'skew' ELSE 'rect' END AS shape
  FROM {lineitem}),
rooms AS (
  SELECT *, CAST(coalesce(sum(w + gap) OVER (PARTITION BY plan_id ORDER BY room_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x0,
    CAST(coalesce(sum(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY room_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS flat
  FROM numbered),
vertices AS (
  SELECT plan_id, room_ix, category, vix, CAST(x0 + floor(fx * w / 2.0) + dx AS BIGINT) AS ix, CAST(floor(fyn * h / CAST(fyd AS DOUBLE)) AS BIGINT) AS iy
  FROM rooms JOIN shape_vertices s ON rooms.shape = s.shape),
edges AS (
  SELECT plan_id, room_ix, category, vix AS eix, ix AS ax, iy AS ay,
    coalesce(lead(ix) OVER (PARTITION BY plan_id, room_ix ORDER BY vix), first_value(ix) OVER (PARTITION BY plan_id, room_ix ORDER BY vix)) AS bx,
    coalesce(lead(iy) OVER (PARTITION BY plan_id, room_ix ORDER BY vix), first_value(iy) OVER (PARTITION BY plan_id, room_ix ORDER BY vix)) AS by_
  FROM vertices),
access AS (
  SELECT plan_id, room_ix AS edge_ix, room_ix AS a, room_ix + 1 AS b, CASE WHEN l_partkey % 3 = 0 THEN 'entrance' ELSE 'door' END AS kind
  FROM (SELECT *, lead(room_ix) OVER (PARTITION BY plan_id ORDER BY room_ix) AS next_ix FROM rooms) AS followed WHERE next_ix IS NOT NULL),
plans AS (
  SELECT o_orderkey AS plan_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'rplan' WHEN '2-HIGH' THEN 'msd units' WHEN '3-MEDIUM' THEN 'houseganpp' WHEN '4-NOT SPECIFIED' THEN 'housegan' ELSE 'housediffusion' END AS grp,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'msd' ELSE 'rplan' END AS corpus,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'msd-unit' ELSE 'rplan' END AS kind,
    CASE o_orderpriority WHEN '2-HIGH' THEN 0.02 WHEN '3-MEDIUM' THEN 0.28125 WHEN '4-NOT SPECIFIED' THEN 0.5625 ELSE 0.0703125 END AS pixel,
    CASE WHEN o_orderpriority = '2-HIGH' THEN concat('b', CAST(o_custkey % 97 AS VARCHAR(20))) ELSE concat('p', CAST(o_orderkey AS VARCHAR(20))) END AS cluster
  FROM {orders})"""


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts by plan_id the derived tables have: it grows with the line items, so that a part, and what a task holds, does not."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / MOST), min(few, math.ceil(rows / LEAST)))


def table(spark: SparkSession, sf_dir: str, name: str, n: int | None = None) -> DataFrame:
    """One of the derived tables, in n parts by plan_id (parts() where n is None).

    Plans are small and many, so all that belongs to a plan stays in its part: joins on plan_id and more are told to use that.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # by their files' size alone, tables with a row for each of millions of plans would be broadcast
    spark.conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)
    # a part's plans and rooms are bounded, so arrays are gathered by hashing
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", MOST)
    items = read("lineitem") if name == "plans" else read("lineitem").repartition(n or parts(spark, sf_dir), "l_orderkey")
    return spark.sql(f"WITH {ctes('{lineitem}', '{orders}')} SELECT * FROM {name}", lineitem=items, orders=read("orders"))


def staged_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The edge table, written once in buckets of plan_id, and their number: for queries that read it more than once."""
    n = parts(spark, sf_dir)
    edges = table(spark, sf_dir, "edges", n).select("plan_id", "room_ix", "category", "eix", "ax", "ay", "bx", "by_")
    return stage_by(edges, "plan_id", "edges", n), n


def staged_vertices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The vertex table, written once like staged_edges()."""
    n = parts(spark, sf_dir)
    return stage_by(table(spark, sf_dir, "vertices", n), "plan_id", "vertices", n), n


def group_order() -> str:
    """A CASE expression giving a group's place in reports."""
    return "CASE grp " + " ".join(f"WHEN '{g}' THEN {i}" for i, (g, _, _) in enumerate(GROUPS)) + " END"
