"""Searches of a graph of many meetings from its matrix of bits in tiles, which neither the driver nor a broadcast holds.

From many sources a group of them gets the rows of a matrix of up to HELD bits by a shuffle, and its task searches all levels
(``paths.Bits``). From few, or of a larger matrix, a level is one job: each tile is multiplied with its columns' values, a
column for each source, and the products are summed by rows. What moves then is vertices times sources, not edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.graph import Graph
from netmetrics.operators import dense, levels
from netmetrics.sources.shared import dropped, shared_path, stored

#: Bits of a matrix that a task holds, sources of a group at least, and values of a level at most.
HELD, GROUP, VALUES = 2**31, 64, 2**22
#: Rows of a tile that are numbers at a time.
ROWS = 1024
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1)[:, 0]
STATE = "i int, d binary, sigma binary, delta binary, new long"


def tiled(g: Graph) -> tuple[dense.Layout, DataFrame]:
    """Where vertices lie, by id, and the tiles of the matrix; made once for each graph."""
    if g.tiles is None:
        ids = g.vertices.select("id").distinct().toArrow()["id"].to_numpy()  # dense.MOST vertices at most
        at = dense.Layout(pa.table({"id": ids, "degree": np.zeros(len(ids), np.int64)}), None)
        g.tiles = (at, dense.matrix(g, at))
    return g.tiles


def holds(g: Graph) -> bool:
    """Can a task hold the matrix?"""
    return len(tiled(g)[0].ids) ** 2 <= HELD


def over_groups(g: Graph, sources: DataFrame | None, f: Callable, schema: str) -> DataFrame:
    """f over the places of each group's sources, as ``paths.over_sources``; the matrix comes by a shuffle, once for each group."""
    from netmetrics.operators.paths import Bits

    at, matrix = tiled(g)
    n, size = len(at.ids), 64 * at.words
    ids = (g.vertices if sources is None else sources).select(F.col("id").cast("long").alias("id")).distinct()
    groups = max(1, min(-(-ids.count() // GROUP), 3 * g.spark.sparkContext.defaultParallelism))
    own = ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("c")).agg(F.collect_list("id").alias("s"))  # a group's share
    none = [F.lit(None).cast(t).alias(c) for c, t in matrix.dtypes]
    dealt = matrix.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("c"), F.lit(None).cast("array<long>").alias("s"), *matrix.columns)
    shared = g.spark.sparkContext.broadcast(at.ids)

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mine = shared.value, np.zeros(0, np.int64)
        bits, more = np.zeros((n, -(-n // 8)), np.uint8), [np.zeros((3, 0), np.int64)]
        for p in dense.pieces_of(batches):
            if p["s"].is_valid:
                mine = p["s"].values.to_numpy()
                continue
            i, k = p["i"].as_py() * size, p["k"].as_py() * size
            line = dense.bits_of(p, size)[: max(0, n - i), : max(0, bits.shape[1] - k // 8)]
            bits[i : i + line.shape[0], k // 8 : k // 8 + line.shape[1]] = REVERSED[line]
            row, col, mult = dense.repeated_of(p, size)
            more.append(np.stack([row + i, col + k, mult - 1]))
        row, to, times = np.concatenate(more, 1)
        place = np.searchsorted(ids, mine)
        there = (place < n) & (ids[np.minimum(place, n - 1)] == mine)
        yield from f(Bits(ids, bits, row.astype(np.int64), to.astype(np.int64), times.astype(float)), iter(place[there].tolist()))

    rows = dealt.unionByName(own.select("c", "s", *none))
    return rows.repartition(groups, "c").groupBy("c").applyInArrow(search, schema)


def _matrix_of(x: bytes | pa.Buffer, kind: type, columns: int) -> np.ndarray:
    return np.frombuffer(x, kind).reshape(-1, columns)


def _row(i: int, d: np.ndarray, sigma: np.ndarray, delta: np.ndarray, new: int) -> pa.RecordBatch:
    own = [pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (d, sigma, delta)), pa.array([new], pa.int64())]
    return pa.RecordBatch.from_arrays(own, ["i", "d", "sigma", "delta", "new"])


def _times(matrix: DataFrame, x: DataFrame, size: int, columns: int) -> DataFrame:
    """(i, got): of each tile (i, k) the product with the values x (k, x) of its columns; no row where those are all 0."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in dense.pieces_of(batches):
            x = _matrix_of(p["x"].as_buffer(), float, columns)
            bits, out = dense.bits_of(p, size), np.empty((size, columns))
            for lo in range(0, size, ROWS):
                out[lo : lo + ROWS] = np.unpackbits(bits[lo : lo + ROWS], axis=1, bitorder="little").astype(float) @ x
            row, col, mult = dense.repeated_of(p, size)
            if len(row):  # repeated edges are bits already
                np.add.at(out, row, (mult - 1)[:, None] * x[col])
            yield pa.RecordBatch.from_arrays([pa.array([p["i"].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["i", "got"])

    met = matrix.join(F.broadcast(x), "k")  # VALUES numbers at most
    return met.mapInArrow(product, "i int, got binary")


def _step(matrix: DataFrame, state: DataFrame, size: int, columns: int, level: int, back: bool) -> DataFrame:
    """The state after one more level, forward (path counts) or back (dependencies)."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                d = _matrix_of(b.column("d")[r].as_buffer(), np.int32, columns)
                sigma, delta = (_matrix_of(b.column(c)[r].as_buffer(), float, columns) for c in ("sigma", "delta"))
                x = np.divide(1.0 + delta, sigma, out=np.zeros_like(sigma), where=d == level) if back else np.where(d == level, sigma, 0.0)
                if x.any():
                    yield pa.RecordBatch.from_arrays([b.column("i").slice(r, 1), pa.array([x.tobytes()], pa.binary())], ["k", "x"])

    def merge(parts: pa.Table, old: pa.Table) -> pa.Table:
        d = _matrix_of(old["d"][0].as_buffer(), np.int32, columns).copy()
        sigma, delta = (_matrix_of(old[c][0].as_buffer(), float, columns).copy() for c in ("sigma", "delta"))
        got = np.zeros_like(sigma)
        for p in sorted(x.as_py() for x in parts["got"]):  # a block's tiles; the same sum in any order of arrival
            got += _matrix_of(p, float, columns)
        if back:
            delta += np.where(d == level - 1, sigma * got, 0.0)
            new = 0
        else:
            got[d >= 0] = 0.0
            d[got > 0] = level + 1
            sigma += got
            new = int((got > 0).sum())
        return pa.Table.from_batches([_row(old["i"][0].as_py(), d, sigma, delta, new)])

    parts = _times(matrix, state.mapInArrow(values, "k int, x binary"), size, columns)
    return parts.groupBy("i").cogroup(state.groupBy("i")).applyInArrow(merge, STATE)


def dependencies(g: Graph, sources: DataFrame | None) -> DataFrame:
    """(id, s, betweenness): what each vertex gains from each source, if anything."""
    at, matrix = tiled(g)
    size, ids = 64 * at.words, at.ids
    path, some = shared_path(g.spark, "dependencies"), False
    shared = g.spark.sparkContext.broadcast(ids)
    for own in levels.batches(g, sources, max(1, min(128, VALUES // max(1, len(ids))))):
        place = np.searchsorted(ids, own)

        def start(batches: Iterator[pa.RecordBatch], place=place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    here = np.flatnonzero(place // size == i)
                    d, sigma = np.full((size, len(place)), -1, np.int32), np.zeros((size, len(place)))
                    d[place[here] - i * size, here], sigma[place[here] - i * size, here] = 0, 1.0
                    yield _row(i, d, sigma, np.zeros_like(sigma), len(here))

        def found(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    delta = _matrix_of(b.column("delta")[r].as_buffer(), float, len(own))
                    v, k = np.nonzero(delta)
                    rows = [shared.value[v + b.column("i")[r].as_py() * size], np.array(own)[k], delta[v, k]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["id", "s", "betweenness"])

        state, level = stored(g.spark.range(0, at.blocks, 1, at.blocks).mapInArrow(start, STATE), "level0"), 0
        while True:
            new = stored(_step(matrix, state, size, len(own), level, False), f"level{level + 1}")
            dropped(state)
            state = new
            if not state.agg(F.sum("new")).first()[0]:
                break
            level += 1
        for d in range(level, 1, -1):
            new = stored(_step(matrix, state, size, len(own), d, True), f"back{d}")
            dropped(state)
            state = new
        state.mapInArrow(found, "id long, s long, betweenness double").write.mode("append").parquet(path)
        dropped(state)
        some = True
    return g.spark.read.parquet(path) if some else g.spark.createDataFrame([], "id long, s long, betweenness double")
