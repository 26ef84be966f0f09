"""Searches of graphs that are too large to be arrays in a task: level by level with joins, a batch of sources at a time.

The adjacency is bucketed by its source, and so is each level's table by its vertex: a row for each vertex of the level, with
a bit or a path count for each source of the batch. A step joins the level with the adjacency in place, sums by the vertex
that is reached, which is the one exchange of a level, and takes off what the last two levels hold, again in place: a
neighbour of level L lies on level L - 1, L or L + 1. A batch's tables are deleted before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.functions.ordered import prefix_ranked
from netmetrics.graph import Graph
from netmetrics.sources.shared import bucketed, dropped, shared_path, stored

#: Sources of a batch: of searches that tell distances, a bit each, and of those that count paths, a column each.
BITS, COUNTS = 512, 64
#: Leaves are searched apart where at most one vertex of so many is left without them.
CORE = 8


def word(k: int) -> int:
    """A long with bit k set."""
    return (1 << k) if k < 63 else -(1 << 63)


def adjacency(g: Graph) -> DataFrame:
    """(src, dst, mult) of a graph, bucketed by src; made once for each graph."""
    if g.bucketed is None:
        parts = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
        g.bucketed = bucketed(g.adjacency().repartition(parts, "src"), "adjacency", "src")
    return g.bucketed


def parted(g: Graph) -> tuple[Graph, DataFrame] | None:
    """The graph without its leaves, and the leaves (u, p), each with its only neighbour; None where more than one vertex of
    CORE would be left (and for graphs of meetings, whose leaves are not looked for). For distances: multiplicities are 1.

    Of two vertices that have only each other the lesser stays. A leaf is one step farther from everything than its
    neighbour, so that all distances follow from those of what is left.
    """
    if g.leaves is None and g.groups is None:
        ties = stored(adjacency(g).groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("p")), "ties")
        own = ties.where("n = 1").join(ties.select(F.col("src").alias("p"), F.col("n").alias("m")), "p").where("m > 1 or src > p")
        leaves = stored(own.select(F.col("src").alias("u"), "p"), "leaves")
        dropped(ties)
        if CORE * (g.n() - leaves.count()) > g.n():
            g.leaves = ()
        else:
            gone = lambda x: leaves.select(F.col("u").alias(x))
            edges = adjacency(g).where("src < dst").join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti")
            g.leaves = (Graph(g.vertices.join(gone("id"), "id", "left_anti"), stored(edges, "core")), leaves)
    return g.leaves or None


def batches(g: Graph, sources: DataFrame | None, size: int) -> Iterator[list[int]]:
    """The ids of the sources (id; all vertices if None) that the graph has, at most ``size`` at a time."""
    ids = g.vertices.select("id") if sources is None else sources.select(F.col("id").cast("long").alias("id")).join(g.vertices.select("id"), "id", "left_semi")
    ranked = stored(prefix_ranked(ids.distinct(), "id"), "sources")
    n = ranked.count()
    for at in range(0, n, size):
        yield sorted(r["id"] for r in ranked.where((F.col("rank") > at) & (F.col("rank") <= at + size)).select("id").collect())  # at most ``size``
    dropped(ranked)


def _other(table: DataFrame, columns: list[str], mark: str) -> DataFrame:
    return table.select("v", *(F.col(x).alias(x + mark) for x in columns))


def distance_levels(g: Graph, ids: list[int]) -> Iterator[tuple[int, DataFrame]]:
    """(level, table (v, m0, m1, ...)): bit k of word w is set if source 64 w + k of ``ids`` has the vertex on this level."""
    adj, words = adjacency(g), [f"m{w}" for w in range(-(-len(ids) // 64))]
    rows = [(x, *(word(k % 64) if k // 64 == w else 0 for w in range(len(words)))) for k, x in enumerate(ids)]
    level, none = 0, g.spark.createDataFrame([], ", ".join(["v long", *(f"{x} long" for x in words)]))
    before, front = none, _by_vertex(g.spark.createDataFrame(rows, none.schema), "level0")
    while not front.isEmpty():
        yield level, front
        level += 1
        before, front = front, bucketed(next_level(front, before, adj, words), f"level{level}", "v")
    dropped(front)


def _by_vertex(df: DataFrame, name: str) -> DataFrame:
    return bucketed(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v"), name, "v")


def next_level(front: DataFrame, before: DataFrame, adj: DataFrame, words: list[str]) -> DataFrame:
    """The level after ``front``: one exchange, by the vertices that are reached."""
    got = front.join(adj, front["v"] == adj["src"]).groupBy(F.col("dst").alias("v")).agg(*(F.bit_or(x).alias(x) for x in words))
    both = got.join(_other(front, words, "_f"), "v", "left").join(_other(before, words, "_b"), "v", "left")
    left = [F.col(x).bitwiseAND(F.bitwise_not(F.coalesce(f"{x}_f", F.lit(0)).bitwiseOR(F.coalesce(f"{x}_b", F.lit(0))))).alias(x) for x in words]
    return both.select("v", *left).where(reduce(Column.__or__, (F.col(x) != 0 for x in words)))


def _named_bits(ids: list[int]) -> Column:
    """The sources whose bits are set."""
    powers = F.array(*(F.lit(word(k)).cast("long") for k in range(64)))

    def named(w: int) -> Column:
        own = F.array(*(F.lit(x).cast("long") for x in ids[64 * w : 64 * w + 64]))
        return F.filter(own, lambda _, k: F.col(f"m{w}").bitwiseAND(F.get(powers, k)) != 0)

    parts = [named(w) for w in range(-(-len(ids) // 64))]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def distances_of(levels: list[tuple[int, DataFrame]], ids: list[int]) -> DataFrame:
    """(s, v, d) of a batch's levels."""
    return reduce(DataFrame.unionByName, [t.select(F.explode(_named_bits(ids)).alias("s"), "v", F.lit(d).alias("d")) for d, t in levels])


def batch_distances(g: Graph, ids: list[int]) -> DataFrame:
    """(s, v, d) from the sources ``ids``, a stored table."""
    levels = list(distance_levels(g, ids))
    out = stored(distances_of(levels, ids), "distances")
    dropped(*(t for _, t in levels))
    return out


def distances(g: Graph, sources: DataFrame | None = None, batch: int = BITS) -> DataFrame:
    """(s, v, d): hop distances; unreachable pairs are absent. State: a bit for each vertex and source of a batch.

    All distances of a graph that is mostly leaves are joined from those of the rest.
    """
    if sources is None and parted(g):
        return _with_leaves(distances(g.leaves[0], None, batch), g.leaves[1])
    path, some = shared_path(g.spark, "distances"), False
    for ids in batches(g, sources, batch):
        part = batch_distances(g, ids)
        part.write.mode("append").parquet(path)
        dropped(part)
        some = True
    return g.spark.read.parquet(path) if some else g.spark.createDataFrame([], "s long, v long, d int")


def _with_leaves(near: DataFrame, leaves: DataFrame) -> DataFrame:
    """(s, v, d) of all vertices from those between vertices that are no leaves."""
    to = near.unionByName(near.join(leaves.select(F.col("p").alias("v"), "u"), "v").select("s", F.col("u").alias("v"), (F.col("d") + 1).alias("d")))
    # few neighbours have all leaves, so rows are dealt by both ends before the leaves' own rows arise
    to = stored(to.repartition("s", "v"), "to")
    own = leaves.select("u", F.col("u").alias("v"), F.lit(0).alias("d")).toDF("s", "v", "d")
    return to.unionByName(to.join(leaves.withColumnRenamed("p", "s"), "s").where("u <> v").select(F.col("u").alias("s"), "v", (F.col("d") + 1).alias("d"))).unionByName(own)


def _hung(levels: list[tuple[int, DataFrame]], weights: np.ndarray) -> DataFrame:
    """(v, d, n): of the leaves that hang on the batch's sources, ``weights`` of each, n are at distance d of the vertex."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(k).to_numpy() for k in range(2, b.num_columns)], 1).astype("<i8")
            n = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : len(weights)] @ weights
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["v", "d", "n"])

    words = [x for x in levels[0][1].columns if x != "v"]
    return reduce(DataFrame.unionByName, [t.select("v", F.lit(d + 1).alias("d"), *words) for d, t in levels]).mapInArrow(weighed, "v long, d int, n long").where("n > 0")


def histogram_of(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(v, d, n): at how many sources of the batch each vertex has this distance, counted from the words."""
    parts = [t.select("v", F.lit(d).alias("d"), reduce(Column.__add__, (F.bit_count(x) for x in t.columns if x != "v")).cast("long").alias("n")) for d, t in levels]
    return reduce(DataFrame.unionByName, parts)


def distance_histograms(g: Graph, sources: DataFrame | None = None, batch: int = BITS) -> DataFrame:
    """(v, d, n): at distance d, 0 included, each vertex has n of the sources (all vertices if None).

    n rows by diameter, not by n; nothing is listed by pairs. Of a graph that is mostly leaves only the rest is searched.
    """
    path, some = shared_path(g.spark, "histograms"), False
    core, leaves = (sources is None and parted(g)) or (g, None)
    hung = None if leaves is None else stored(leaves.groupBy("p").agg(F.count("*").alias("n")), "hung")
    for ids in batches(core, sources, batch):
        levels = list(distance_levels(core, ids))
        histogram_of(levels).write.mode("append").parquet(path)
        if hung is not None:
            own = {r["p"]: r["n"] for r in hung.where(F.col("p").isin(ids)).collect()}  # at most a batch
            _hung(levels, np.array([own.get(x, 0) for x in ids], np.int64)).write.mode("append").parquet(path)
        dropped(*(t for _, t in levels))
        some = True
    if not some:
        return g.spark.createDataFrame([], "v long, d int, n long")
    h = g.spark.read.parquet(path).groupBy("v", "d").agg(F.sum("n").alias("n"))
    if leaves is None:
        return h
    h = stored(h, "core")
    dropped(hung)
    # as its neighbour, a step farther, but the leaf itself is at 0, not at 2
    own = h.join(leaves.withColumnRenamed("p", "v"), "v").select(F.col("u").alias("v"), (F.col("d") + 1).alias("d"), (F.col("n") - F.when(F.col("d") == 1, 1).otherwise(0)).alias("n"))
    return h.unionByName(own.where("n > 0")).unionByName(leaves.select(F.col("u").alias("v"), F.lit(0).alias("d"), F.lit(1).cast("long").alias("n")))


def count_levels(g: Graph, ids: list[int]) -> Iterator[tuple[int, DataFrame]]:
    """(level, table (v, b, g0, g1, ...)): the number of shortest paths from source k, 0 if the vertex is not on this level of
    it, and the bits b of those it is on.
    """
    adj, names = adjacency(g), [f"g{k}" for k in range(len(ids))]
    schema = ", ".join(["v long", "b long", *(f"{x} double" for x in names)])
    rows = [(x, word(k), *(1.0 if k == j else 0.0 for j in range(len(ids)))) for k, x in enumerate(ids)]
    level, before, front = 0, g.spark.createDataFrame([], schema), _by_vertex(g.spark.createDataFrame(rows, schema), "count0")
    while not front.isEmpty():
        yield level, front
        level += 1
        before, front = front, bucketed(next_counts(front, before, adj, names), f"count{level}", "v")
    dropped(front)


def next_counts(front: DataFrame, before: DataFrame, adj: DataFrame, names: list[str]) -> DataFrame:
    got = front.join(adj, front["v"] == adj["src"]).groupBy(F.col("dst").alias("v")).agg(*(F.sum(F.col(x) * F.col("mult")).alias(x) for x in names))
    both = got.join(_other(front, ["b"], "_f"), "v", "left").join(_other(before, ["b"], "_b"), "v", "left")
    seen = F.coalesce("b_f", F.lit(0)).bitwiseOR(F.coalesce("b_b", F.lit(0)))
    new = both.select("v", seen.alias("seen"), *names)
    new = new.select("v", *(F.when(F.col("seen").bitwiseAND(F.lit(word(k))) == 0, F.col(x)).otherwise(0.0).alias(x) for k, x in enumerate(names)))
    bits = reduce(Column.bitwiseOR, (F.when(F.col(x) > 0, F.lit(word(k))).otherwise(F.lit(0)).cast("long") for k, x in enumerate(names)))
    return new.select("v", bits.alias("b"), *names).where(F.col("b") != 0)


def path_counts(g: Graph, sources: DataFrame | None = None, batch: int = COUNTS) -> DataFrame:
    """(s, v, d, sigma): distances and numbers of shortest paths (by multiplicity)."""
    path, some = shared_path(g.spark, "paths"), False
    for ids in batches(g, sources, batch):
        levels = list(count_levels(g, ids))
        for d, t in levels:
            own = F.array(*(F.struct(F.lit(x).cast("long").alias("s"), F.col(f"g{k}").alias("sigma")) for k, x in enumerate(ids)))
            t.select("v", F.explode(F.filter(own, lambda x: x["sigma"] > 0)).alias("t")).select("t.s", "v", F.lit(d).alias("d"), "t.sigma").write.mode("append").parquet(path)
        dropped(*(t for _, t in levels))
        some = True
    return g.spark.read.parquet(path) if some else g.spark.createDataFrame([], "s long, v long, d int, sigma double")


def dependencies(g: Graph, sources: DataFrame | None = None, batch: int = COUNTS) -> DataFrame:
    """(id, betweenness): what vertices gain from the sources, some vertices in several rows.

    From a batch's farthest level back; a level's vertices hand (1 + delta) / sigma to their neighbours, which are summed by
    the neighbour, again one exchange, and count where that lies one level nearer.
    """
    path, some, adj = shared_path(g.spark, "dependencies"), False, adjacency(g)
    for ids in batches(g, sources, batch):
        levels = list(count_levels(g, ids))
        names = range(len(ids))
        last = levels[-1][1].select("v", *(F.col(f"g{k}") for k in names), *(F.lit(0.0).alias(f"d{k}") for k in names))
        kept: list[DataFrame] = []
        for d, t in reversed(levels[1:-1]):
            given = last.select("v", *(F.when(F.col(f"g{k}") > 0, (1.0 + F.col(f"d{k}")) / F.col(f"g{k}")).otherwise(0.0).alias(f"c{k}") for k in names))
            got = given.join(adj, given["v"] == adj["src"]).groupBy(F.col("dst").alias("v")).agg(*(F.sum(F.col(f"c{k}") * F.col("mult")).alias(f"c{k}") for k in names))
            own = t.drop("b").join(got, "v", "left").select("v", *(f"g{k}" for k in names), *((F.col(f"g{k}") * F.coalesce(f"c{k}", F.lit(0.0))).alias(f"d{k}") for k in names))
            last = bucketed(own, f"delta{d}", "v")
            kept.append(last)
            last.select(F.col("v").alias("id"), reduce(Column.__add__, (F.col(f"d{k}") for k in names)).alias("betweenness")).where("betweenness <> 0").write.mode("append").parquet(path)
            some = True
        dropped(*(t for _, t in levels), *kept)
    return g.spark.read.parquet(path) if some else g.spark.createDataFrame([], "id long, betweenness double")
