"""Connected components of an edge table, by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Rounds grow with the logarithm of a component's diameter; more than this many are an error, not a result.
MOST_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, folder: str, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    With ``known``, the components of earlier edges (each node once), only what the new edges join is worked on: known
    components are nodes then, and the result holds the nodes of both.
    """
    if known is not None:
        return _joined(edges, folder, name, known)
    own = c.written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}-0")
    mark = _print(own)
    for k in range(1, MOST_ROUNDS):
        # large star: neighbours that are larger than a node go to the least of its neighbourhood
        both = own.union(own.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = c.written(small.where("u != v").distinct(), folder, f"{name}-{k}")
        if k > 1:
            c.drop_folder(edges.sparkSession, f"{folder}/{name}-{k - 2}")
        last, mark, own = mark, _print(new), new
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    nodes = own.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(own.select(F.col("v"), F.col("v")).distinct())


def _joined(edges: DataFrame, folder: str, name: str, known: DataFrame) -> DataFrame:
    def at(column: str) -> DataFrame:
        return known.select(F.col("node").alias(column), F.col("component").alias(f"of_{column}"))

    of = edges.where("a != b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    of = c.written(of.select("a", "b", F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v")), folder, f"{name}-of")
    roots = components(of.select(F.col("u").alias("a"), F.col("v").alias("b")), folder, f"{name}-roots").select(F.col("node").alias("component"), F.col("component").alias("root"))
    nodes = known.unionByName(of.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("u").alias("component")), F.struct(F.col("b").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*")).distinct()
    return c.written(nodes.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), folder, f"{name}-all")
