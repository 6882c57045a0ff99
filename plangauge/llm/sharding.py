"""Two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core.columns import others

#: Buckets whose offsets are summed in one window.
RUN = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(df: DataFrame, n_shards: int, *, text_col: str = "text", id_col: str = "doc_id", seed: int = 20260916, bucket_bytes: int = 8 << 20, buckets_per_task: int = 4) -> DataFrame:
    """df's rows in a seeded random order, cut into n_shards shards: adds `shard` (int, from 0) and `slot` (long, gapless from 0 in its shard).

    Pass one scatters rows by a seeded hash into buckets of about bucket_bytes of text. Pass two shuffles each bucket
    (Spark's shuffle() is a Fisher-Yates shuffle). The buckets in order, end to end, are one random permutation; it is cut into
    n_shards runs whose row counts differ by one at most.

    The hash takes the row's place in the scan besides its id, so that rows with equal or null ids and repeated rows scatter like
    any others. df must therefore deliver its rows in the same order when it is read again: a table, not the output of a shuffle.
    Null texts count as empty; a long text makes its bucket larger by its own size and no more; an empty table gives an empty
    result; input columns named shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = df.select(*others(df, "shard", "slot"), F.monotonically_increasing_id().alias("_pg_row"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(text_size(F.col(text_col)))).first()
    n_buckets = max(1, math.ceil((size or 0) / bucket_bytes))
    payload = others(rows, "_pg_row")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_pg_row")), F.lit(n_buckets)).alias("_pg_bucket")
    order = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("_pg_row")).alias("_pg_order")

    counts = rows.select(bucket).groupBy("_pg_bucket").agg(F.count(F.lit(1)).alias("_pg_n")).withColumn("_pg_run", F.floor(F.col("_pg_bucket") / RUN))
    runs = counts.groupBy("_pg_run").agg(F.sum("_pg_n").alias("_pg_run_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_pg_run", F.coalesce(F.sum("_pg_run_n").over(before(Window.orderBy("_pg_run"))), F.lit(0)).alias("_pg_run_start"))
    within = F.coalesce(F.sum("_pg_n").over(before(Window.partitionBy("_pg_run").orderBy("_pg_bucket"))), F.lit(0))
    starts = counts.withColumn("_pg_within", within).join(runs, "_pg_run").select("_pg_bucket", (F.col("_pg_run_start") + F.col("_pg_within")).alias("_pg_start"))

    tasks = max(1, math.ceil(n_buckets / buckets_per_task))
    scattered = rows.select(bucket, order, "_pg_row", F.struct(*payload).alias("_pg_rec"))
    scattered = scattered.repartition(tasks, "_pg_bucket").sortWithinPartitions("_pg_bucket", "_pg_order", "_pg_row")
    piles = scattered.groupBy("_pg_bucket").agg(F.collect_list("_pg_rec").alias("_pg_pile"))
    piles = piles.join(starts.hint("shuffle_hash"), "_pg_bucket").select("_pg_start", F.shuffle("_pg_pile", seed).alias("_pg_pile"))
    dealt = piles.select("_pg_start", F.posexplode("_pg_pile").alias("_pg_pos", "_pg_rec"))
    place = F.col("_pg_start") + F.col("_pg_pos")
    first = F.expr(f"(cast(_pg_shard as long) * {n} + {n_shards - 1}) div {n_shards}")
    out = dealt.withColumn("_pg_place", place).withColumn("_pg_shard", F.expr(f"cast((_pg_place * {n_shards}) div {max(n, 1)} as int)"))
    return out.select("_pg_rec.*", F.col("_pg_shard").alias("shard"), (F.col("_pg_place") - first).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """shard() and write one folder `shard=k` for each shard, its rows in slot order within each file."""
    shard(df, n_shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
