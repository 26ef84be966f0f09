"""An undirected graph as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.functions import meetings
from netmetrics.sources.shared import stored


def require_graph(g: object) -> Graph:
    if not isinstance(g, Graph):
        raise TypeError("Not a graph object")
    return g


class Graph:
    """vertices (id, name) and edges (src, dst); every edge goes both ways.

    simplify: loops and repeated edges count once or not at all. Without it a repeated edge keeps its multiplicity in
    degrees, path counts and neighbourhoods, and a loop counts two in the degree; no path uses a loop.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, simplify: bool = True) -> None:
        self.vertices = vertices.select(F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name"))
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.simplify = simplify
        self.arrays = self.names = self.matrix = None  # what operators.paths made of a small graph
        self.tiles: tuple | None = None  # what operators.tiles made of a graph of many meetings
        self.over = self.repeated = -1  # limits that its edges, or its repeated ones, are known to exceed
        self.bucketed: DataFrame | None = None  # the adjacency that operators.levels joins with
        self.leaves: tuple | None = None  # what operators.levels found: the graph without its leaves and those, or nothing
        self._canonical: DataFrame | None = None
        self._oriented: DataFrame | None = None
        self.groups: DataFrame | None = None  # of a graph of meetings, from which pairs are counted without a shuffle of pairs

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, simplify: bool = True) -> Graph:
        """edges (src, dst) of numbers; without vertices, those that have an edge, named by their number."""
        if not edges.where(F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
            raise ValueError("an edge needs both its ends")
        if vertices is None:
            ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            vertices = ids.withColumn("name", F.col("id").cast("string"))
        return cls(vertices, edges, simplify)

    @classmethod
    def of_meetings(cls, groups: DataFrame, vertices: DataFrame, simplify: bool = True) -> Graph:
        """groups (at, u) of numbers, no row twice: an edge between two members for each group that both are in."""
        pairs = groups.join(groups.select("at", F.col("u").alias("w")), "at").where("u < w")
        g = cls(vertices, pairs.select(F.col("u").alias("src"), F.col("w").alias("dst")), simplify)
        g.groups = groups.select(F.col("at").cast("long").alias("at"), F.col("u").cast("long").alias("u"))
        return g

    @property
    def spark(self):
        return self.edges.sparkSession

    def canonical(self) -> DataFrame:
        """(src, dst, mult) with src < dst, and src = dst for loops where they are kept."""
        if self._canonical is not None:
            return self._canonical
        if self.groups is not None:
            pair = meetings.pairs(self.groups)
            return pair.withColumn("mult", F.lit(1).cast("long")) if self.simplify else pair
        pair = self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        if self.simplify:
            return pair.where("src < dst").distinct().withColumn("mult", F.lit(1).cast("long"))
        return pair.groupBy("src", "dst").agg(F.count("*").alias("mult"))

    def adjacency(self) -> DataFrame:
        """(src, dst, mult), both directions, without loops: where paths go."""
        half = self.canonical().where("src < dst")
        both = F.explode(F.array(F.struct("src", "dst", "mult"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "mult")))
        return half.select(both.alias("t")).select("t.*")  # the pairs are found once

    def degree(self) -> DataFrame:
        """(id, degree) for every vertex; isolated ones have 0."""
        if self.groups is not None and self._canonical is None:
            ends = meetings.degrees(self.groups, not self.simplify)
        else:
            ends = self.canonical().select(F.explode(F.array("src", "dst")).alias("id"), F.col("mult").alias("degree"))
        return self.vertices.select("id").join(ends.groupBy("id").agg(F.sum("degree").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def oriented(self) -> DataFrame:
        """(x, y, dx, dy, mult): each edge once, from its end of lower (degree, id) to the other; no loops.

        A table in the shared folder, made once for each graph: neighbourhood measures read it instead of the source.
        """
        if self._oriented is None:
            self._canonical = stored(self.canonical(), "canonical")  # degrees and all that follows start from it
            d = self.degree()
            e = self.canonical().where("src < dst").join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
            low, high = F.struct(F.col("ds").alias("d"), F.col("src").alias("i")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("i"))
            e = e.select(F.least(low, high).alias("l"), F.greatest(low, high).alias("h"), "mult")
            self._oriented = stored(e.select(F.col("l.i").alias("x"), F.col("h.i").alias("y"), F.col("l.d").alias("dx"), F.col("h.d").alias("dy"), "mult"), "oriented")
        return self._oriented

    def n(self) -> int:
        return self.vertices.count()

    def named(self, scores: DataFrame, column: str, empty: Column | None = None) -> DataFrame:
        """(id, name, column) for all vertices; vertices without a score get ``empty`` (0.0)."""
        value = F.coalesce(F.col(column), F.lit(0.0) if empty is None else empty)
        return self.vertices.join(scores.select("id", column), "id", "left").select("id", "name", value.alias(column))
