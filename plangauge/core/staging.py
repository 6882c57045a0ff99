"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plangauge-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def stage_by(df: DataFrame, key: str, name: str, parts: int | None) -> DataFrame:
    """Like stage(), in `parts` buckets of key, so that joins, windows and groups on key, or on more, read it without a shuffle; stage() where parts is None.

    df is best partitioned by key into as many parts already: then it is written as it stands, a file a bucket.
    """
    if parts is None:
        return stage(df, name)
    spark = df.sparkSession
    kept = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{kept}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(kept)
    out = spark.table(kept)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
