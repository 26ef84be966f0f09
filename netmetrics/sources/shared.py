"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder; a temporary one only in local mode where none is set.

    Its folder is deleted when the application ends, since results are read from it until then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/netmetrics"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the end of its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """df as a table in the shared folder, dealt to as many buckets as shuffle partitions by ``key`` and sorted by it.

    Joins and sums on the key alone need no exchange of it. The table leaves the catalog at once; only its files stay.
    """
    spark = df.sparkSession
    table = f"netmetrics_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # analysed while the table is known
    spark.sql(f"DROP TABLE {table}")
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
