"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from netmetrics.graph import Graph  # noqa: E402
from netmetrics.operators.bridging import bridging  # noqa: E402
from netmetrics.plans import queries as graph_queries  # noqa: E402

HEADLINE = ("degree", "triangles", "shared_neighbors", "ens", "constraint", "path_counts", "betweenness", "betweenness_forest", "bridging", "kpp_single_fits", "keyplayer_greedy")


def random_graph(spark: SparkSession, n: int = 100, p: float = 0.3, seed: int = 1) -> Graph:
    """G(n, p), the graph of the one published timing."""
    rng = random.Random(seed)
    edges = [(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1) if rng.random() < p]
    src, dst = zip(*edges, strict=True)
    return Graph.from_edges(spark.createDataFrame(pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_, took = graph_queries.queries(), {}
    runs = {name: (lambda f=all_[name]: f(spark, sf_dir)) for name in HEADLINE} | {"bridging_random_100_30": lambda: bridging(random_graph(spark))}
    runs["degree"]().count()  # the JVM starts
    for name, run in runs.items():
        best = float("inf")
        for _ in range(2):
            began = time.time()
            run().write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
