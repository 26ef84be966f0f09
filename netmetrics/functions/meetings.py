"""Pairs of members of the same group, counted without a shuffle of pairs.

Pairs grow with the square of a group, the members do not. So the members are shuffled: vertices are dealt into blocks by hash,
each member goes to the tiles (its block, any block), and a tile has all groups' members of two blocks, so that it counts its
pairs for good. A tile takes its vertices a few at a time; what it holds is its members and some PIECE pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.sources.shared import stored

#: Members of a block, about, in few and in many blocks; blocks from which there are tiles for all tasks; pairs counted at once.
FEW, MANY, BLOCKS, PIECE = 25_000, 4_000_000, 12, 500_000

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _expanded(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places lo[k] .. lo[k] + count[k] - 1 of all k, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)


def tile_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], same: bool, piece: int = PIECE) -> Iterator[Pairs]:
    """(x, y, number of shared groups), x < y where left and right are the same; left and right are (group, vertex) of members."""
    ids, row = np.unique(left[1], return_inverse=True)
    others, column = np.unique(right[1], return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, at = row[order], left[0][order]
    order = np.argsort(right[0], kind="stable")
    column, groups = column[order], right[0][order]
    lo = np.searchsorted(groups, at, "left")
    count = np.searchsorted(groups, at, "right") - lo
    first = np.searchsorted(row, np.arange(len(ids) + 1))  # a vertex's members
    done = np.append(0, np.cumsum(count))
    before = done[first]
    k, width = 0, len(others)
    while k < len(ids):
        end = max(k + 1, int(np.searchsorted(before, before[k] + piece, "right")) - 1)
        a, b = first[k], first[end]
        pairs = done[b] - done[a]
        if end == k + 1 or (end - k) * width <= 4 * pairs:
            counts = np.zeros((end - k) * width, np.int64)
            while a < b:  # one vertex may have more pairs than a piece
                c = min(b, max(a + 1, int(np.searchsorted(done, done[a] + piece, "right")) - 1))
                counts += np.bincount(np.repeat(row[a:c] - k, count[a:c]) * width + column[_expanded(lo[a:c], count[a:c])], minlength=len(counts))
                a = c
            cell = np.flatnonzero(counts != 0)
            counts = counts[cell]
        else:
            cell, counts = np.unique(np.repeat(row[a:b] - k, count[a:b]) * width + column[_expanded(lo[a:b], count[a:b])], return_counts=True)
        x, y = cell // width + k, cell % width
        if same:
            keep = x < y
            x, y, counts = x[keep], y[keep], counts[keep]
        yield ids[x], others[y], counts
        k = end


def over_tiles(groups: DataFrame, f: Callable[[Iterator[Pairs]], Iterator[pa.RecordBatch]], schema: str, blocks: int | None = None, block: Column | None = None) -> DataFrame:
    """f over the pairs (x, y, shared groups) of each tile; every pair of vertices that share a group is in one tile, once.

    groups (at, u): longs, the members of each group, none repeated. Shuffled are the members times the blocks.
    block: of a member, from 0, instead of one by hash.
    """
    own = stored(groups, "groups")
    if blocks is None:
        n = own.count()
        blocks = max(min(BLOCKS, n // FEW + 1), -(-n // MANY))
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int") if block is None else block
    lists = own.groupBy(block.alias("b"), "at").agg(F.collect_list("u").alias("u"))  # of a group, a block's members at most
    dealt = lists.select("at", "u", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select((F.least("b", "o") * blocks + F.greatest("b", "o")).alias("tile"), (F.col("b") <= F.col("o")).alias("low"), "at", "u")

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j = divmod(key[0].as_py(), blocks)
        u = t["u"].combine_chunks()
        size = np.diff(u.offsets.to_numpy())
        at, low, u = np.repeat(t["at"].to_numpy(), size), np.repeat(t["low"].to_numpy(), size), u.flatten().to_numpy()
        one = (at[low], u[low])
        yield from f(tile_pairs(one, one if i == j else (at[~low], u[~low]), i == j))

    return dealt.repartition(blocks * (blocks + 1) // 2, "tile").groupBy("tile").applyInArrow(tile, schema)


def pairs(groups: DataFrame, blocks: int | None = None) -> DataFrame:
    """(src, dst, mult), src < dst: the pairs that share a group, and in how many."""

    def rows(got: Iterator[Pairs]) -> Iterator[pa.RecordBatch]:
        for x, y, m in got:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(m)], ["src", "dst", "mult"])

    return over_tiles(groups, rows, "src long, dst long, mult long", blocks)


def degrees(groups: DataFrame, multiple: bool, blocks: int | None = None) -> DataFrame:
    """(id, degree), a vertex in several rows: its partners, each as often as groups are shared if ``multiple``."""

    def rows(got: Iterator[Pairs]) -> Iterator[pa.RecordBatch]:
        for x, y, m in got:
            for v in (x, y):
                ids, at = np.unique(v, return_inverse=True)
                n = np.bincount(at, m if multiple else None, len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "degree"])

    return over_tiles(groups, rows, "id long, degree long", blocks)
