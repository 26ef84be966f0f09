"""Graphs of the test tables, over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmetrics.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peers(spark: SparkSession, sf_dir: str, simplify: bool = True) -> Graph:
    """Users with an event in the same minute. Not simplified, an edge for each minute."""
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.date_trunc("minute", "ts")).alias("at"), F.col("user_id").cast("long").alias("u")).where("u is not null and at is not null").distinct()
    users = e.select(F.col("u").alias("id")).distinct().withColumn("name", F.concat(F.lit("user "), F.col("id").cast("string")))
    return Graph.of_meetings(e, users, simplify)


def ring(spark: SparkSession, sf_dir: str) -> Graph:
    """The forest of places, and suppliers of consecutive keys tied to each other: many cycles, a few edges a vertex."""
    g = places(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    return Graph(g.vertices, g.edges.unionByName(s.join(s.select(F.col("src").alias("dst")), F.col("dst") == F.col("src") + 1)))


def places(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers tied to their nations, nations to their regions: a forest. Nations are -1 - key, regions -1001 - key."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    up = s.select(F.col("s_suppkey").alias("src"), (-1 - F.col("s_nationkey")).cast("long").alias("dst"))
    up = up.unionByName(n.select((-1 - F.col("n_nationkey")).cast("long").alias("src"), (-1001 - F.col("n_regionkey")).cast("long").alias("dst")))
    v = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    v = v.unionByName(n.select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("name")))
    return Graph(v.unionByName(r.select((-1001 - F.col("r_regionkey")).cast("long").alias("id"), F.col("r_name").alias("name"))), up)
