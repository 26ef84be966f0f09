"""Shortest paths: distances and path counts from many sources at once.

A graph whose adjacency fits LIMIT is sent to the tasks as arrays, and every task searches from its share of the sources; so
is one of more edges but few vertices, as a matrix of bits of about the same size (``Bits``). A larger one is searched level
by level with joins, a batch of sources at a time (``levels``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.graph import Graph, require_graph
from netmetrics.operators import dense, levels, tiles
from netmetrics.sources.shared import dropped, stored

#: Directed edges of a graph that is sent whole to every task: 24 bytes each.
LIMIT = 1_000_000
#: Bits of a matrix for each directed edge of the limit: as much memory, 32 bytes.
BITS = 256
#: Sources that a task searches from together in a matrix, and rows of it that are numbers at a time.
TOGETHER, ROWS = 128, 512
#: Distances that are listed together, and rows of a piece of them, at most.
VALUES, PIECE = 2**22, 2**18
#: Vertices from which leaves are searched apart, which costs some jobs.
SEARCHED = 3000
#: Edges, counted both ways, and vertices of a graph that a task holds: 24 bytes each.
SHARED = 4_000_000
PATHS = "s long, v long, d int, sigma double"


class Arrays:
    """Adjacency in rows: ids, and for vertex k the places row[k] : row[k + 1] of its neighbours."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, mult: np.ndarray) -> None:
        self.ids = ids
        order = np.argsort(src, kind="stable")
        self.to, self.mult = np.searchsorted(ids, dst[order]), mult[order].astype(float)
        self.row = np.searchsorted(src[order], np.append(ids, ids[-1] + 1 if len(ids) else 0))

    def levels(self, s: int, without: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Distances (-1: none), path counts, and for each level its (from, to, multiplicity) edges."""
        n = len(self.ids)
        d, sigma = np.full(n, -1, np.int32), np.zeros(n)
        d[s], sigma[s], front, out = 0, 1.0, np.array([s]), []
        while len(front):
            count = self.row[front + 1] - self.row[front]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.row[front], count)
            a, b = np.repeat(front, count), self.to[at]
            open_ = d[b] < 0
            if without:
                open_ &= ~(((a == without[0]) & (b == without[1])) | ((a == without[1]) & (b == without[0])))
            a, b, m = a[open_], b[open_], self.mult[at][open_]
            np.add.at(sigma, b, sigma[a] * m)
            front = np.unique(b)
            d[front] = d[a[0]] + 1 if len(a) else 0
            if len(a):
                out.append((a, b, m))
        return d, sigma, out

    def distances(self, s: int) -> np.ndarray:
        return self.levels(s)[0]

    def searches(self, places: Iterator[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, distances, path counts) of each source."""
        for s in places:
            yield s, *self.levels(s)[:2]

    def dependencies(self, places: Iterator[int]) -> np.ndarray:
        """What each vertex adds to betweenness for the sources."""
        total = np.zeros(len(self.ids))
        for s in places:
            total += self._dependencies(s)
        return total

    def _dependencies(self, s: int) -> np.ndarray:
        _, sigma, levels = self.levels(s)
        delta = np.zeros(len(self.ids))
        for a, b, m in reversed(levels):
            np.add.at(delta, a, sigma[a] * m * (1 + delta[b]) / sigma[b])
        delta[s] = 0
        return delta


class Bits:
    """The adjacency as a matrix of bits, row by row, and beside it how many more times repeated edges are there."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, row: np.ndarray, to: np.ndarray, more: np.ndarray) -> None:
        self.ids, self.bits = ids, bits
        order = np.argsort(row, kind="stable")
        self.row, self.to, self.more = row[order], to[order], more[order]

    def distances(self, s: int, without: tuple[int, int] | None = None) -> np.ndarray:
        """A level is all rows of the one before, joined by or; without an edge, if one is given."""
        n = len(self.ids)
        d = np.full(n, -1, np.int32)
        d[s], front, level = 0, np.array([s]), 0
        while len(front):
            level += 1
            reached = np.unpackbits(np.bitwise_or.reduce(self.bits[front], 0), count=n) != 0
            if without and d[without[0]] == level - 1:  # the only vertex of the front that may not give the other end
                rest = front[front != without[0]]
                reached[without[1]] = (self.bits[rest, without[1] >> 3] >> (7 - (without[1] & 7)) & 1).any()
            front = np.flatnonzero(reached & (d < 0))
            d[front] = level
            if (d >= 0).all():
                break
        return d

    def times(self, x: np.ndarray) -> np.ndarray:
        """The adjacency, with multiplicities, times a matrix."""
        n, out = len(self.ids), np.empty_like(x)
        for k in range(0, n, ROWS):
            part = np.unpackbits(self.bits[k : k + ROWS], axis=1, count=n).astype(float)
            a, b = np.searchsorted(self.row, (k, k + ROWS))
            part[self.row[a:b] - k, self.to[a:b]] += self.more[a:b]
            out[k : k + ROWS] = part @ x
        return out

    def _together(self, places: Iterator[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Sources, and by vertex and source the distances and path counts."""
        while own := list(itertools.islice(places, TOGETHER)):
            at = np.arange(len(own))
            d, sigma = np.full((len(self.ids), len(own)), -1, np.int32), np.zeros((len(self.ids), len(own)))
            d[own, at], sigma[own, at], level = 0, 1.0, 0
            while (d < 0).any():
                new = self.times(np.where(d == level, sigma, 0.0))
                new[d >= 0] = 0.0
                if not new.any():
                    break
                level += 1
                d[new > 0] = level
                sigma += new
            yield own, d, sigma

    def searches(self, places: Iterator[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for own, d, sigma in self._together(places):
            for k, s in enumerate(own):
                yield s, d[:, k], sigma[:, k]

    def dependencies(self, places: Iterator[int]) -> np.ndarray:
        total = np.zeros(len(self.ids))
        for _, d, sigma in self._together(places):
            delta = np.zeros_like(sigma)
            for level in range(int(d.max()), 1, -1):
                given = np.divide(1.0 + delta, sigma, out=np.zeros_like(sigma), where=d == level)
                delta += np.where(d == level - 1, sigma * self.times(given), 0.0)
            total += delta.sum(1)
        return total


def held(g: Graph, limit: int = LIMIT) -> Arrays | Bits | None:
    """The graph in the form that tasks search, if one is small enough: by edges, or by vertices."""
    a = arrays(g, limit)
    return a if a is not None else _matrix(g, limit)


def in_groups(g: Graph) -> bool:
    """Is it a graph of many meetings that groups of sources search, each with the whole matrix from a shuffle?"""
    return dense.suits(g) and tiles.holds(g)


def _matrix(g: Graph, limit: int) -> Bits | None:
    """The graph as bits, or None if they are more than BITS for each edge of the limit, or more than ``limit`` edges are repeated."""
    if g.matrix is None:
        ids = np.sort(g.vertices.select("id").distinct().limit(int((BITS * limit) ** 0.5) + 1).toArrow()["id"].to_numpy())
        n = len(ids)
        if n * n > BITS * limit:
            return None
        if limit <= g.repeated:
            return None  # found before
        shared = g.spark.sparkContext.broadcast(ids)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if not got:
                return
            t = pa.Table.from_batches(got)
            src, to, mult = t["src"].to_numpy(), np.searchsorted(shared.value, t["dst"].to_numpy()), t["mult"].to_numpy()
            order = np.argsort(src, kind="stable")
            own, first = np.unique(src[order], return_index=True)
            for x, at in zip(own, np.split(order, first[1:]), strict=True):
                line, extra = np.zeros(n, bool), mult[at] > 1
                line[to[at]] = True
                rows = [[int(np.searchsorted(shared.value, x))], [np.packbits(line).tobytes()], [to[at][extra].astype(np.int32)], [(mult[at][extra] - 1).astype(float)]]
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["row", "bits", "to", "more"])

        # a vertex's edges come to one task: at most n rows of n bits for the driver
        parts = max(1, min(n, 4 * g.spark.sparkContext.defaultParallelism))
        rows = stored(g.adjacency().repartition(parts, "src").mapInArrow(pack, "row int, bits binary, to array<int>, more array<double>"), "matrix")
        if (rows.agg(F.sum(F.size("to"))).first()[0] or 0) > limit:
            dropped(rows)
            g.repeated = limit
            return None
        bits, row, to, more = np.zeros((n, -(-n // 8)), np.uint8), [], [], []
        for b in rows.toArrow().to_batches():
            for r, line, own, times in zip(b["row"].to_pylist(), b["bits"].to_pylist(), b["to"], b["more"], strict=True):
                bits[r] = np.frombuffer(line, np.uint8)
                to.append(own.values.to_numpy())
                more.append(times.values.to_numpy())
                row.append(np.full(len(to[-1]), r))
        dropped(rows)
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        g.matrix = Bits(ids, bits, join(row, np.int64), join(to, np.int64), join(more, float))
    return g.matrix if len(g.matrix.ids) ** 2 <= BITS * limit else None


def arrays(g: Graph, limit: int = LIMIT) -> Arrays | None:
    """The graph as arrays, or None if it has more than ``limit`` edges (counted both ways) or vertices.

    One job of at most 1.5 x limit + 2 rows; a graph remembers its arrays, and the names in the order of their ids.
    """
    if g.arrays is None:
        if limit <= g.over:
            return None  # found before
        most = limit // 2 + limit + 2
        half = g.canonical().where("src < dst").withColumn("name", F.lit(None).cast("string"))
        ids = g.vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0).cast("long").alias("mult"), "name")
        got = half.unionByName(ids).limit(most).toArrow()
        edge = got["mult"].to_numpy() > 0
        if got.num_rows == most or 2 * edge.sum() > limit or (~edge).sum() > limit:
            g.over = limit
            return None
        src, mult = got["src"].to_numpy(), got["mult"].to_numpy()[edge]
        a, b = src[edge], got["dst"].drop_null().to_numpy()
        own, at = np.unique(src[~edge], return_index=True)
        g.names = got["name"].filter(pa.array(~edge)).take(pa.array(at))
        g.arrays = Arrays(own, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([mult, mult]))
    return g.arrays if max(len(g.arrays.to), len(g.arrays.ids)) <= limit else None


def over_sources(g: Graph, a: Arrays | Bits, sources: DataFrame | None, f: Callable[[Arrays | Bits, Iterator[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the places of each task's sources, with the broadcast arrays."""
    shared = g.spark.sparkContext.broadcast(a)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value

        def places() -> Iterator[int]:
            for b in batches:
                ids = b.column(0).to_numpy()
                at = np.searchsorted(x.ids, ids)
                yield from (int(k) for k, i in zip(at, ids, strict=True) if k < len(x.ids) and x.ids[k] == i)

        yield from f(x, places())

    ids = (g.vertices if sources is None else sources).select(F.col("id").cast("long").alias("id")).distinct()
    return ids.repartition(min(len(a.ids) // 8 + 1, g.spark.sparkContext.defaultParallelism * 2)).mapInArrow(scan, schema)


def over_shared(g: Graph, f: Callable[[Arrays, Iterator[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame | None:
    """As ``over_sources``, but a group of sources gets the edges by a shuffle: neither the driver nor a broadcast has them.

    None of up to SEARCHED vertices, of more than SHARED edges or vertices, and of mostly leaves, where joins do less.
    """
    n = g.n()
    if not SEARCHED < n <= SHARED or g.groups is not None or levels.parted(g):
        return None
    adj = levels.adjacency(g)
    if adj.count() > SHARED:
        return None
    groups = max(1, min(n // TOGETHER, 3 * g.spark.sparkContext.defaultParallelism))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("c")
    no = F.lit(None).cast("long")
    rows = adj.select(every, "src", "dst", "mult", F.lit(False).alias("own"))
    ids = g.vertices.select(F.col("id").alias("src")).distinct().withColumn("of", F.pmod(F.xxhash64("src"), F.lit(groups)).cast("int"))
    rows = rows.unionByName(ids.select(every, "src", no.alias("dst"), no.alias("mult"), F.col("of")).select("c", "src", "dst", "mult", (F.col("c") == F.col("of")).alias("own")))

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        src, own = t["src"].to_numpy(), t["own"].to_numpy()
        edge = t["dst"].is_valid().to_numpy()
        x = Arrays(np.sort(src[~edge]), src[edge], t["dst"].drop_null().to_numpy(), t["mult"].drop_null().to_numpy())
        yield from f(x, iter(np.searchsorted(x.ids, src[own]).tolist()))

    return rows.repartition(groups, "c").groupBy("c").applyInArrow(search, schema)


def _listed(x: Arrays | Bits, own: list[int], d: np.ndarray, *more: np.ndarray) -> Iterator[list[np.ndarray]]:
    """(s, v, d, more) of some sources, by vertex and source: of each vertex all rows together, and those of one component.

    Ids repeat in runs, and the sources in the same order, which takes files a fraction of the room of rows by source.
    """
    ids, order = x.ids[own], np.argsort((d >= 0).argmax(1), kind="stable")
    step = max(1, PIECE // len(own))
    for lo in range(0, len(order), step):
        at = order[lo : lo + step]
        v, k = np.nonzero(d[at] >= 0)
        yield [ids[k], x.ids[at[v]], *(y[at[v], k] for y in (d, *more))]


def _some(x: Arrays | Bits, places: Iterator[int]) -> Iterator[list[int]]:
    """Sources whose rows are listed together: at most VALUES distances."""
    while own := list(itertools.islice(places, max(1, min(TOGETHER, VALUES // max(1, len(x.ids)))))):
        yield own


def _rows(x: Arrays | Bits, places: Iterator[int]) -> Iterator[pa.RecordBatch]:
    for own in _some(x, places):
        _, d, sigma = zip(*x.searches(iter(own)), strict=True)
        for r in _listed(x, own, np.stack(d, 1), np.stack(sigma, 1)):
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in r], ["s", "v", "d", "sigma"])


def shortest_paths(g: Graph, sources: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(s, v, d, sigma): distance and number of shortest paths (by multiplicity); unreachable pairs are absent.

    sources (id): only from these, all vertices otherwise.
    """
    require_graph(g)
    a = held(g, limit)
    if a is not None:
        return over_sources(g, a, sources, _rows, PATHS)
    if in_groups(g):
        return tiles.over_groups(g, sources, _rows, PATHS)
    return levels.path_counts(g, sources)


def distances(g: Graph, sources: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(s, v, d): hop distances alone, which by joins need a bit of state for each pair; unreachable pairs are absent."""
    require_graph(g)
    a = held(g, limit)
    if a is not None:
        return over_sources(g, a, sources, _near, "s long, v long, d int")
    return tiles.over_groups(g, sources, _near, "s long, v long, d int") if in_groups(g) else levels.distances(g, sources)


def _near(x: Arrays | Bits, places: Iterator[int]) -> Iterator[pa.RecordBatch]:
    for own in _some(x, places):
        for r in _listed(x, own, np.stack([x.distances(s) for s in own], 1)):
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in r], ["s", "v", "d"])


def _counted(x: Arrays | Bits, places: Iterator[int]) -> Iterator[pa.RecordBatch]:
    for s in places:
        n = np.bincount(x.distances(s) + 1)[1:]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x.ids[s])), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["v", "d", "n"])


def distance_histograms(g: Graph, limit: int = LIMIT) -> DataFrame:
    """(v, d, n): each vertex has n vertices at distance d, itself at 0 included. No pairs are listed.

    Arrays of more than SEARCHED vertices that are mostly leaves are not searched from each: ``levels`` searches the rest.
    """
    a = held(require_graph(g), limit)
    if isinstance(a, Arrays) and len(a.ids) > SEARCHED and levels.CORE * (np.diff(a.row) != 1).sum() <= len(a.ids):
        a = None
    if a is not None:
        return over_sources(g, a, None, _counted, "v long, d int, n long")
    return tiles.over_groups(g, None, _counted, "v long, d int, n long") if in_groups(g) else levels.distance_histograms(g)


def cohesion_of(g: Graph, limit: int = LIMIT) -> DataFrame:
    """(cohesion) as ``cohesion``, from the histograms."""
    n = g.n()
    return distance_histograms(g, limit).where("d > 0").agg((F.coalesce(F.sum(F.col("n") / F.col("d")), F.lit(0.0)) / 2 / max(1, n * (n - 1))).alias("cohesion"))


def cohesion(paths: DataFrame, n: int) -> DataFrame:
    """(cohesion): the sum of 1 / d over unordered pairs, by n (n - 1); 0 for fewer than two vertices."""
    return paths.where("s < v").agg((F.coalesce(F.sum(1.0 / F.col("d")), F.lit(0.0)) / max(1, n * (n - 1))).alias("cohesion"))
