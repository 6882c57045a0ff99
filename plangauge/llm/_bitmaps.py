"""Bits in rows: Spark's bitmap functions as a compact set of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.core.staging import stage

#: Bits in one bitmap row (4 KB), as Spark's bitmap functions have them.
BITMAP_BITS = 32768


def bit_of(bitmap: str, slot: str) -> Column:
    """Whether the slot's bit is set in the bitmap of its bucket; false if there is no bitmap."""
    byte = f"substring({bitmap}, cast({slot} % {BITMAP_BITS} div 8 as int) + 1, 1)"
    return F.expr(f"coalesce(shiftright(cast(conv(hex({byte}), 16, 10) as int), cast({slot} % 8 as int)) & 1, 0) = 1")


def bitmaps(slots: DataFrame, slot: str) -> DataFrame:
    """(_pg_bucket, _pg_bitmap) of the slots, non-negative longs that may repeat."""
    return slots.groupBy(F.expr(f"{slot} div {BITMAP_BITS}").alias("_pg_bucket")).agg(F.expr(f"bitmap_construct_agg({slot} % {BITMAP_BITS})").alias("_pg_bitmap"))


def mark(rows: DataFrame, marked: DataFrame, row_col: str, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """rows plus boolean `_pg_marked`: whether their row_col is among those of marked (one column of that name, no nulls).

    One bit a row says it exactly, so rows stay where they are while the bitmaps' size, counted first, is within broadcast_bytes;
    beyond that both sides shuffle on the row number.
    """
    bits = stage(bitmaps(marked, row_col), "marks")
    if bits.count() * (BITMAP_BITS // 8) <= broadcast_bytes:
        placed = rows.withColumn("_pg_bucket", F.expr(f"{row_col} div {BITMAP_BITS}")).join(F.broadcast(bits), "_pg_bucket", "left")
        return placed.withColumn("_pg_marked", bit_of("_pg_bitmap", row_col)).drop("_pg_bucket", "_pg_bitmap")
    known = marked.select(row_col, F.lit(True).alias("_pg_in")).distinct()
    return rows.join(known, row_col, "left").withColumn("_pg_marked", F.coalesce("_pg_in", F.lit(False))).drop("_pg_in")
