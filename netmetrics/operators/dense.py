"""Triangles of a graph of many meetings, summed at their corners without being listed.

Such a graph has so many edges that a matrix of bits is smaller than their list, and far more triangles. Its matrix is made in
tiles of two blocks of vertices, where pairs are counted anyway (``functions.meetings``), and a task multiplies the rows of
two blocks where they have an edge: their bits are joined by and, and counted. Columns lie by degree, so that a word's bits have
few weights. Repeated edges are few: what they add is found from their list. What moves is compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.functions import meetings
from netmetrics.graph import Graph
from netmetrics.sources.shared import stored

#: Vertices from and up to which a graph is taken, and bits of the matrix for each meeting of two, at most.
LEAST, MOST, BITS = 4000, 2**18, 256
#: Blocks of vertices at least, and vertices of a block about at most, of many blocks.
BLOCKS, BLOCK = 12, 8192
#: Rows and columns that are numbers at a time, where all pairs are multiplied, and words that are counted at a time.
ROWS, COLUMNS, WORDS = 2048, 1024, 256
#: Rows that are handed on together, about.
LISTED = 2**18
PIECE = "i int, k int, bits binary, repeated int, more binary"


def suits(g: Graph) -> bool:
    """Is it a graph of meetings whose bits are fewer than BITS for each meeting of two?"""
    if g.groups is None:
        return False
    n = g.n()
    met = g.groups.groupBy("at").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("x")).first()["x"]
    return LEAST <= n <= MOST and n * n <= BITS * (met or 0)


class Layout:
    """Where vertices lie: by rising degree, in blocks of as many words."""

    def __init__(self, degrees: pa.Table, blocks: int | None) -> None:
        ids, degree = degrees["id"].to_numpy(), degrees["degree"].to_numpy()
        order = np.lexsort((ids, degree))
        self.ids, self.degree = ids[order], degree[order]
        total = -(-len(ids) // 64)
        self.blocks = blocks or max(BLOCKS, -(-64 * total // BLOCK))
        self.words = -(-total // self.blocks)  # of a block
        self.weight = np.zeros(64 * self.words * self.blocks)
        self.weight[: len(ids)] = 1.0 / np.maximum(1, self.degree)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, the bits in them that are of one degree, and the weight of those."""
        new = np.append(True, self.degree[1:] != self.degree[:-1]) if len(self.ids) else np.zeros(0, bool)
        first = np.flatnonzero(new | (np.arange(len(self.ids)) % 64 == 0))
        size = np.diff(np.append(first, len(self.ids))).astype(np.uint64)
        bits = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << (size % np.uint64(64))) - np.uint64(1))
        return first // 64, bits << (first % 64).astype(np.uint64), self.weight[first]


def _piece(i: int, k: int, line: np.ndarray, row: np.ndarray, col: np.ndarray, mult: np.ndarray) -> pa.RecordBatch:
    """PIECE of the cells that have an edge, and the repeated ones among them."""
    cell = row * len(line) + col
    order = np.argsort(cell)
    more = np.concatenate([np.diff(cell[order], prepend=0), mult[order]]).astype(np.uint32)
    packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (np.packbits(line, axis=1, bitorder="little"), more)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((i, k, packed[0], len(row), packed[1]), kinds, strict=True)], ["i", "k", "bits", "repeated", "more"])


def bits_of(p: dict[str, pa.Scalar], size: int) -> np.ndarray:
    """The bits of a piece, eight columns in a byte from the lowest on."""
    return np.frombuffer(pa.decompress(p["bits"].as_buffer(), size * size // 8, codec="zstd"), np.uint8).reshape(size, size // 8)


def repeated_of(p: dict[str, pa.Scalar], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and multiplicity of a piece's repeated edges."""
    n = p["repeated"].as_py()
    x = np.frombuffer(pa.decompress(p["more"].as_buffer(), 8 * n, codec="zstd"), np.uint32).astype(np.int64) if n else np.zeros(0, np.int64)
    cell = np.cumsum(x[:n])
    return cell // size, cell % size, x[n:]


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield {c: batch.column(c)[n] for c in batch.schema.names}


def matrix(g: Graph, at: Layout) -> DataFrame:
    """PIECE: the bits of block i's rows in block k's columns, and its repeated edges; none where there is no edge."""
    size = 64 * at.words

    def packed(got: Iterator[meetings.Pairs]) -> Iterator[pa.RecordBatch]:
        line, row, col, mult, i, k = None, [], [], [], 0, 0
        for x, y, m in got:
            if not len(x):
                continue
            if line is None:
                line, i, k = np.zeros((size, size), bool), int(x[0]) // size, int(y[0]) // size
            x, y, more = x - i * size, y - k * size, m > 1
            line[x, y] = True
            if not g_simple:
                row.append(x[more])
                col.append(y[more])
                mult.append(m[more])
        if line is None:
            return
        row, col, mult = (np.concatenate(t) if t else np.zeros(0, np.int64) for t in (row, col, mult))
        if i == k:
            line |= line.T
            row, col, mult = np.append(row, col), np.append(col, row), np.append(mult, mult)
            yield _piece(i, i, line, row, col, mult)
        else:
            yield _piece(i, k, line, row, col, mult)
            yield _piece(k, i, line.T, col, row, mult)

    g_simple = g.simplify
    places = g.spark.createDataFrame(pa.table({"u": at.ids, "p": np.arange(len(at.ids))}))
    own = g.groups.join(F.broadcast(places), "u").select("at", F.col("p").alias("u"))  # MOST vertices at most
    return stored(meetings.over_tiles(own, packed, PIECE, at.blocks, F.floor(F.col("u") / size).cast("int")), "matrix")


class _Strip:
    """A block's rows as words, and its repeated edges (row, column, multiplicity) by row, then column."""

    def __init__(self, size: int, at: Layout) -> None:
        self.size, self.at = size, at
        self.bits, self.found = np.zeros((size, at.words * at.blocks), np.uint64), []

    def add(self, p: dict[str, pa.Scalar]) -> None:
        k = p["k"].as_py()
        self.bits[:, k * self.at.words : (k + 1) * self.at.words] = np.ascontiguousarray(bits_of(p, self.size)).view(np.uint64)
        row, col, mult = repeated_of(p, self.size)
        if len(row):
            self.found.append(np.stack([row, col + k * self.size, mult]))

    def done(self) -> _Strip:
        row, col, mult = np.concatenate([np.zeros((3, 0), np.int64), *self.found], 1)
        order = np.lexsort((col, row))
        self.row, self.col, self.mult, self.found = row[order], col[order], mult[order], []
        self.first = np.searchsorted(self.row, np.arange(self.size + 1))
        return self

    def twice(self) -> np.ndarray:
        """The bits of edges that are there twice, as most repeated ones are."""
        out, own = np.zeros_like(self.bits), self.mult == 2
        np.bitwise_or.at(out, (self.row[own], self.col[own] >> 6), np.uint64(1) << (self.col[own] & 63).astype(np.uint64))
        return out

    def numbers(self, lo: int, hi: int, k: int, end: int, kind: type) -> np.ndarray:
        """The multiplicities of some rows and columns (those of whole words)."""
        out = _unpacked(self.bits[lo:hi, k // 64 : end // 64]).astype(kind)
        part = slice(self.first[lo], self.first[hi])
        row, col, mult = self.row[part], self.col[part], self.mult[part]
        own = (col >= k) & (col < end)
        out[row[own] - lo, col[own] - k] = mult[own]
        return out


def _strips(key: int, batches: Iterator[pa.RecordBatch], at: Layout) -> tuple[int, int, _Strip, _Strip]:
    """The two blocks of a tile, and their rows."""
    i, j = divmod(key, at.blocks)
    own = {x: _Strip(64 * at.words, at) for x in (i, j)}
    for p in pieces_of(batches):
        own[p["i"].as_py()].add(p)
    own = {x: s.done() for x, s in own.items()}
    return i, j, own[i], own[j]


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def _counted(one: _Strip, two: _Strip, j: int, same: bool, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, x) of the edges between two blocks, each once: x sums over the common neighbours q the product of iq and jq,
    or (weighted) of 1 / iq, 1 / jq and 1 / the degree of q.
    """
    at, size = one.at, one.size
    edge = _unpacked(one.bits[:, j * at.words : (j + 1) * at.words]) != 0
    r, c = (x.astype(np.int32) for x in np.nonzero(np.triu(edge, 1) if same else edge))
    del edge
    x, first = np.zeros(len(r)), np.searchsorted(r, np.arange(size + 1))
    most = int(np.diff(first).max()) if len(r) else 0
    words, masks, weights = at.parts() if weighted else (np.arange(one.bits.shape[1]), None, None)
    value = lambda n, k: np.add.reduce(n, 1, np.uint32) if weights is None else n @ weights[k : k + WORDS]
    twice = [t.twice() for t in (one, two)] if len(one.col) or len(two.col) else None
    for k in range(0, len(words) if most else 0, WORDS):
        w = words[k : k + WORDS]
        part = lambda bits, w=w: np.ascontiguousarray(bits[:, w])
        own = lambda bits, k=k: part(bits) if masks is None else part(bits) & masks[k : k + WORDS]  # noqa: E731, B023
        a, b, met, ones = own(one.bits), part(two.bits), np.empty((most, len(w)), np.uint64), np.empty((3, most, len(w)), np.uint8)
        if twice:
            a2, b2, also = own(twice[0]), part(twice[1]), np.empty_like(met)
        for i in np.flatnonzero(np.diff(first)):
            s, e = first[i], first[i + 1]
            m, (n, n1, n2) = met[: e - s], ones[:, : e - s]
            np.take(b, c[s:e], 0, m, "clip")
            if twice:
                np.bitwise_count(np.bitwise_and(m, a2[i], also[: e - s]), n1)
            np.bitwise_count(np.bitwise_and(m, a[i], m), n)
            x[s:e] += value(n, k)
            if twice:
                np.take(b2, c[s:e], 0, m, "clip")
                np.bitwise_count(np.bitwise_and(m, a[i], m), n2)
                x[s:e] += (-0.5 if weighted else 1.0) * value(np.add(n1, n2, n1), k)  # 128 at most
    if twice:
        _repeated(one, two, r, c, first, x, weighted)
    return r, c, x


def _repeated(one: _Strip, two: _Strip, r: np.ndarray, c: np.ndarray, first: np.ndarray, x: np.ndarray, weighted: bool) -> None:
    """Add to x what the multiplicities of repeated edges are more, or (weighted) their inverses less, than 1: on both sides, and on
    one of edges that are there more than twice.
    """
    weight = one.at.weight if weighted else np.ones(len(one.at.weight))
    by = np.argsort(c, kind="stable")
    rows = np.arange(one.size + 1)
    begin = np.searchsorted(c[by], rows)
    ways = ((one, two, c, lambda i: slice(first[i], first[i + 1])), (two, one, r, lambda i: by[begin[i] : begin[i + 1]]))
    more = lambda m: 1.0 / m - 1.0 if weighted else m - 1.0
    for t, other, ends, place in ways:  # a block with itself goes both ways too
        often = t.mult > 2
        col, octets = t.col[often], other.bits.view(np.uint8)
        add, own = more(t.mult[often]) * weight[col], np.searchsorted(t.row[often], rows)
        for i in np.flatnonzero(np.diff(own)):
            at, q = place(i), col[own[i] : own[i + 1]]
            to = ends[at]
            met = octets[to[:, None], q >> 3] & (1 << (q & 7)).astype(np.uint8)
            x[at] += (met != 0) @ add[own[i] : own[i + 1]]
    order = np.argsort(two.col, kind="stable")
    columns, row, add = two.col[order], two.row[order], more(two.mult[order])
    for i in np.flatnonzero(np.diff(one.first)):
        own, at = slice(one.first[i], one.first[i + 1]), slice(first[i], first[i + 1])
        q = one.col[own]
        lo = np.searchsorted(columns, q, "left")
        n = np.searchsorted(columns, q, "right") - lo
        both = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        x[at] += np.bincount(row[both], np.repeat(more(one.mult[own]) * weight[q], n) * add[both], one.size)[c[at]]


def _dealt(tiles: DataFrame, b: int) -> DataFrame:
    """The pieces of a block's rows for each tile (the block, any block o)."""
    return tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("o")).withColumn("tile", F.least("i", "o") * b + F.greatest("i", "o"))


def _over_pairs(g: Graph, at: Layout, f: Callable[[int, int, _Strip, _Strip], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the rows of each two blocks; a block's rows are shuffled once for each block."""
    b, shared = at.blocks, g.spark.sparkContext.broadcast(at)

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(*_strips(key[0].as_py(), batches, shared.value))

    return _by_tile(_dealt(matrix(g, at), b).drop("o"), b).applyInArrow(tile, schema)


def _by_tile(dealt: DataFrame, b: int):
    return dealt.repartition(2 * b * (b + 1), "tile").groupBy("tile")  # few partitions get two tiles


def listed(g: Graph, blocks: int | None = None) -> DataFrame:
    """(a, b, c, da, db, dc): each triangle of a simple graph once, by rising (degree, id), with the degrees.

    A tile lists those whose first two vertices lie in its blocks, from the pieces of the third's: bits are shuffled, neither
    wedges nor triangles are.
    """
    at = Layout(stored(g.degree(), "degrees").toArrow(), blocks)  # MOST vertices at most
    b, size = at.blocks, 64 * at.words
    dealt = _dealt(matrix(g, at), b).where(F.col("k") >= F.greatest("i", "o"))
    shared = g.spark.sparkContext.broadcast((at.ids, at.degree))

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = divmod(key[0].as_py(), b)
        own: dict[int, dict[int, np.ndarray]] = {i: {}, j: {}}
        for p in pieces_of(batches):
            own[p["i"].as_py()][p["k"].as_py()] = bits_of(p, size).view(np.uint64)
        if j not in own[i]:
            return
        rows, found = [], 0
        for k in sorted(own[i].keys() & own[j].keys()):
            last = _unpacked(own[j][k])
            for r in range(size):
                to = np.flatnonzero(_unpacked(own[i][j][r : r + 1])[0])
                to = to[to > r] if i == j else to
                third = np.flatnonzero(_unpacked(own[i][k][r : r + 1])[0]) if len(to) else to
                if not len(third):
                    continue
                x, y = np.nonzero(last[np.ix_(to, third)])
                x, y = to[x], third[y]
                if k == j:
                    x, y = x[y > x], y[y > x]
                rows.append(np.stack([np.full(len(x), r + i * size), x + j * size, y + k * size]))
                found += len(x)
                if found >= LISTED:
                    yield _triples(rows)
                    rows, found = [], 0
        if found:
            yield _triples(rows)

    def _triples(rows: list[np.ndarray]) -> pa.RecordBatch:
        ids, degree = shared.value
        x = np.concatenate(rows, 1)
        return pa.RecordBatch.from_arrays([pa.array(y[z]) for y in (ids, degree) for z in x], ["a", "b", "c", "da", "db", "dc"])

    return _by_tile(dealt.select("tile", "i", "k", "bits"), b).applyInArrow(tile, "a long, b long, c long, da long, db long, dc long")


def shared_of_edges(g: Graph, blocks: int | None = None) -> DataFrame:
    """(src, dst, shared) of every edge, both ways: the common neighbours, by multiplicity. Neither they nor edges are shuffled."""
    at = Layout(stored(g.degree(), "degrees").toArrow(), blocks)  # MOST vertices at most

    def counted(i: int, j: int, one: _Strip, two: _Strip) -> Iterator[pa.RecordBatch]:
        r, c, x = _counted(one, two, j, i == j, False)
        for k in range(0, len(r), LISTED):
            a, b = one.at.ids[r[k : k + LISTED] + i * one.size], one.at.ids[c[k : k + LISTED] + j * one.size]
            n = np.rint(x[k : k + LISTED]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(a, b)), pa.array(np.append(b, a)), pa.array(np.append(n, n))], ["src", "dst", "shared"])

    return _over_pairs(g, at, counted, "src long, dst long, shared long")


def crossed(g: Graph, blocks: int | None = None) -> DataFrame:
    """(src, dst, shared) of every ordered pair with a common neighbour, by multiplicity: rows of blocks are multiplied."""
    at = Layout(stored(g.degree(), "degrees").toArrow(), blocks)  # MOST vertices at most

    def products(i: int, j: int, one: _Strip, two: _Strip) -> Iterator[pa.RecordBatch]:
        size, width = one.size, 64 * one.bits.shape[1]
        top = max((int(t.mult.max()) for t in (one, two) if len(t.mult)), default=1)
        kind = np.float32 if top * top * COLUMNS < 2**24 else np.float64  # whole numbers stay exact
        for lo in range(0, size, ROWS):
            hi = min(size, lo + ROWS)
            total = np.zeros((hi - lo, size))
            for k in range(0, width, COLUMNS):
                end = min(width, k + COLUMNS)
                total += one.numbers(lo, hi, k, end, kind) @ two.numbers(0, size, k, end, kind).T
            step = max(1, LISTED // size)
            for s in range(0, hi - lo, step):
                r, c = np.nonzero(total[s : s + step])
                n = total[s : s + step][r, c].astype(np.int64)
                a, b = one.at.ids[r + s + lo + i * size], one.at.ids[c + j * size]
                if i != j:
                    a, b, n = np.append(a, b), np.append(b, a), np.append(n, n)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["src", "dst", "shared"])

    return _over_pairs(g, at, products, "src long, dst long, shared long")


def summed(g: Graph, f: Callable[[np.ndarray], np.ndarray], weighted: bool, blocks: int | None = None) -> DataFrame:
    """(id, degree, x) of every vertex: the sum of f over its edges' x.

    The x of an edge (i, j) is the sum over common neighbours q of ij * iq * jq, or (weighted) of 1 / (ij * iq * jq * degree
    of q). A task has the rows of two blocks.
    """
    degrees = stored(g.degree(), "degrees")
    at = Layout(degrees.toArrow(), blocks)  # MOST vertices at most

    def corners(i: int, j: int, one: _Strip, two: _Strip) -> Iterator[pa.RecordBatch]:
        at, size = one.at, one.size
        r, c, x = _counted(one, two, j, i == j, weighted)
        cell, own = r.astype(np.int64) * size + c, (one.col >= j * size) & (one.col < (j + 1) * size)
        own &= (one.col - j * size > one.row) if i == j else True
        here = np.searchsorted(cell, one.row[own] * size + one.col[own] - j * size)  # repeated edges are edges
        x[here] *= 1.0 / one.mult[own] if weighted else one.mult[own]
        y = f(x)
        sums = np.concatenate([np.bincount(r, y, size), np.bincount(c, y, size)]).astype(float)  # without edges they are whole numbers
        place = np.concatenate([np.arange(size) + i * size, np.arange(size) + j * size])
        hit = (sums != 0) & (place < len(at.ids))
        yield pa.RecordBatch.from_arrays([pa.array(at.ids[place[hit]]), pa.array(sums[hit])], ["id", "x"])

    sums = stored(_over_pairs(g, at, corners, "id long, x double"), "corners").groupBy("id").agg(F.sum("x").alias("x"))
    return degrees.join(sums, "id", "left").select("id", "degree", F.coalesce("x", F.lit(0.0)).alias("x"))
