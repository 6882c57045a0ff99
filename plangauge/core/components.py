"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.core.staging import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node u sends its smallest neighbour to its larger neighbours (large) or to its smaller ones and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # edges run from the larger node u to the smaller node v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, label) for every node of links: label is the smallest node of its component.

    Works on any ordered key type. Each round is written to the shared folder, so that lineage stays short; rounds grow with the
    logarithm of the longest path. A hub with a third of all links is one skewed join key, which adaptive execution splits.
    Self-links and repeated links do no harm; null ends are ignored.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    mark = None
    while True:
        new = stage(_star(_star(now, True), False), name)
        found = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = new
        if found == mark or found[0] == 0:
            break
        mark = found
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
