"""Exact deduplication behind a two-pass Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.core.columns import others
from plangauge.core.staging import stage
from plangauge.llm._bitmaps import BITMAP_BITS, bit_of, bitmaps, mark
from plangauge.llm._skew import join_groups


def normalised(text: Column) -> Column:
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _slot(key: Column, which: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(which)), F.lit(bits))


def repeat_filter(keys: DataFrame, key_col: str, bits: int) -> DataFrame:
    """Pass one: the slots that two or more rows hash to, as bitmap rows (bucket, bitmap); bits / 8 bytes in all at most."""
    slots = keys.select(F.explode(F.array(*[_slot(F.col(key_col), k, bits) for k in (0, 1)])).alias("slot"))
    often = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bitmaps(often, "slot")


def flag_repeats(rows: DataFrame, key_col: str, *, bits_per_row: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """rows plus boolean `_pg_maybe`: true for every row whose key occurs twice or more, and for few others.

    Both bits of a key must be set. The filter has the next power of two over bits_per_row bits for each row. It is broadcast only
    where its size, known beforehand, is within broadcast_bytes; else it is joined by bucket, so rows should be narrow.
    """
    n = rows.count()
    bits = max(BITMAP_BITS, 1 << (n * bits_per_row - 1).bit_length() if n else 0)
    found = repeat_filter(rows.select(key_col), key_col, bits)
    out = rows
    for k in (0, 1):
        bitmap = found.select(F.col("_pg_bucket").alias(f"_pg_b{k}"), F.col("_pg_bitmap").alias(f"_pg_m{k}"))
        out = out.withColumn(f"_pg_s{k}", _slot(F.col(key_col), k, bits)).withColumn(f"_pg_b{k}", F.expr(f"_pg_s{k} div {BITMAP_BITS}"))
        out = out.join(F.broadcast(bitmap) if bits // 8 <= broadcast_bytes else bitmap, f"_pg_b{k}", "left")
    return out.select(*others(rows), (bit_of("_pg_m0", "_pg_s0") & bit_of("_pg_m1", "_pg_s1")).alias("_pg_maybe"))


def _first(id_col: str) -> Column:
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_pg_row").alias("row")))


def resolve(keys: DataFrame, *, id_col: str = "doc_id", key_col: str = "text_key", **options) -> DataFrame:
    """A row for each row of keys (id_col, key_col): plus keep_id, group_size and kept.

    Rows that the filter lets pass are alone in their group and do not move; only the others are grouped by key. Of a group the
    smallest id stays; where that id is repeated with an equal text, or all ids are null, the first such row of the table alone
    stays. keys must be a stored table, read again in the same order; other columns are not read. Null keys do not occur (a null
    text counts as empty); an empty table gives an empty one.
    """
    rows = flag_repeats(keys.select(F.col(id_col), F.col(key_col), F.monotonically_increasing_id().alias("_pg_row")), key_col, **options)
    rest = rows.where(~F.col("_pg_maybe")).select(id_col, key_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = rows.where("_pg_maybe")
    groups = stage(maybe.groupBy(key_col).agg(_first(id_col).alias("_pg_first"), F.count(F.lit(1)).alias("group_size")), "copies")
    grouped = join_groups(maybe, groups, key_col, "group_size").select(id_col, key_col, F.col("_pg_first.id").alias("keep_id"), "group_size", (F.col("_pg_row") == F.col("_pg_first.row")).alias("kept"))
    return rest.unionByName(grouped)


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without copies: of equal texts the row with the smallest id stays, whole; of equal ids, the first such row of the table.

    Only ids, keys and row numbers of suspected rows shuffle; the rows themselves stay where they are. df must be a stored table,
    read again in the same order. Null texts count as empty; rows with null ids go where one with an id is equal; an empty table
    gives an empty one. The column names _pg_row and _pg_marked are reserved.
    """
    keys = stage(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("_pg_row")), "keys")
    maybe = flag_repeats(keys, "key", **options).where("_pg_maybe")
    groups = stage(maybe.groupBy("key").agg(_first("id").alias("_pg_first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    gone = stage(join_groups(maybe, groups, "key", "n").where(F.col("_pg_row") != F.col("_pg_first.row")).select("_pg_row"), "gone")
    rows = df.withColumn("_pg_row", F.monotonically_increasing_id())
    return mark(rows, gone, "_pg_row").where("not _pg_marked").select(*others(df))
