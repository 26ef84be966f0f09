"""Best-fit packing by linear grouping, planned on the histogram of lengths.

The plan never sees documents: a corpus has at most ``capacity`` different lengths, so its histogram is bounded. Lengths
above SMALL are cut into GROUPS groups of about equal cardinality and rounded up to the largest of their group, so there are
few sizes. Configurations (multisets of sizes that fill a sequence) are chosen one after another, each the fullest that the
remaining counts allow, and used as often as they allow. Actual lengths then replace the sizes, a group's longest first; the
last place of a sequence, and what room rounding left beyond it, take the longest lengths that fit there, of whatever group.
Small lengths fill what is left by best fit. The plan is a list of runs of equal sequences, and pieces find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netmetrics.llm import common as c
from netmetrics.llm.tokens import Pieces, Splitter, default_path

CAPACITY, END = 2048, 0
#: Lengths up to SMALL are placed last; the longer ones are rounded within so many groups.
SMALL, GROUPS = 64, 64
#: A configuration whose sizes leave no more than this part of a sequence is full enough: actual lengths fill it up. Plans
#: are made with each, and that of fewest sequences is used.
SLACKS = (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2)
#: Distinct pre-tokens whose ids a task remembers.
REMEMBERED = 400_000


class Ids(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit numbers; asks the tokenizer once for each."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[pretoken] = array("I", self.pieces(pretoken)).tobytes()
        return out


_ids: dict[str, Ids] = {}  # a Python worker keeps what it learned for its next tasks


def _cut(path: str, capacity: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = Splitter(path), _ids.setdefault(path, Ids(path))
        end, of = np.array([END], "<u4").tobytes(), ids.__getitem__
        for b in c.blocks(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = b"".join(map(of, split(text or ""))) + end
                total, at, piece = len(raw) // 4, 0, 0
                while at < total:
                    n = total % capacity if at == 0 and total % capacity else capacity
                    for column, v in zip(rows, (doc_id, piece, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])), strict=True):
                        column.append(v)
                    at, piece = at + n, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return scan


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids and an end id, the long ones cut.

    Where a document is cut its first piece is the one that may be shorter.
    """
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return df.mapInArrow(_cut(path or default_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Runs:
    """Runs of equal sequences: (slots, count) by free room; a slot is (length, first rank)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free = capacity, {}

    def add(self, room: int, slots: list[tuple[int, int]], count: int) -> None:
        if count:
            self.free.setdefault(room, []).append((slots, count))

    def all(self) -> list[tuple[list[tuple[int, int]], int]]:
        return [run for room in sorted(self.free) for run in self.free[room]]


def fullest(sizes: list[int], left: list[int], capacity: int, slack: int = 0) -> list[int]:
    """The multiset of size numbers that fills a sequence best, no size more often than it is left.

    sizes fall. The largest size left is always in, so every size comes to an end; the rest is a subset sum over ever smaller
    sizes, until no more than ``slack`` is free.
    """
    big = next(k for k, n in enumerate(left) if n)
    room = capacity - sizes[big]
    reach = np.full(room + 1, -1, np.int64)  # the size that was added last to reach a sum
    reach[0] = len(sizes)
    for k in range(big, len(sizes)):  # a size is added up to left[k] times
        n = left[k] - (k == big)
        if n <= 0 or sizes[k] > room:
            continue
        open_ = np.flatnonzero(reach >= 0)
        for _ in range(min(n, room // sizes[k])):
            to = open_ + sizes[k]
            to = to[to <= room]
            to = to[reach[to] < 0]
            if not len(to):
                break
            reach[to] = k
            open_ = to
        if (reach[max(0, room - slack) :] >= 0).any():
            break
    members, s = [big], int(np.flatnonzero(reach >= 0)[-1])
    while s:
        members.append(int(reach[s]))
        s -= sizes[members[-1]]
    return sorted(members)


def groups(counts: np.ndarray, small: int, n: int) -> list[list[int]]:
    """Lengths above ``small``, longest first, in at most n groups of about equal cardinality; a length is in one group."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if x > small]
    left, out, room = int(sum(counts[x] for x in lengths)), [], 0
    for x in lengths:
        if room <= 0 and len(out) < n:
            out.append([])
            room = -(-left // (n - len(out) + 1))
        out[-1].append(x)
        room -= int(counts[x])
        left -= int(counts[x])
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, n_groups: int = GROUPS) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs (slots, count) for a histogram (counts[length]): count sequences, each with the slots (length, first rank)."""
    return min((_planned(counts, capacity, small, n_groups, int(x * capacity)) for x in SLACKS), key=lambda runs: sum(n for _, n in runs))


def _planned(counts: np.ndarray, capacity: int, small: int, n_groups: int, slack: int) -> list[tuple[list[tuple[int, int]], int]]:
    rank, left = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    runs = Runs(capacity)
    runs.add(0, [(capacity, 0)], int(left[capacity]))
    left[capacity] = 0
    members = groups(left, small, n_groups)
    sizes, of = [g[0] for g in members], {x: k for k, g in enumerate(members) for x in g}
    there = [int(sum(left[x] for x in g)) for g in members]
    config: list[int] = []
    while any(there):
        if not config or any(there[k] < config.count(k) for k in config):
            config = fullest(sizes, there, capacity, slack)
        use: dict[int, int] = {}  # the lengths of one sequence

        def put(x: int) -> int:
            use[x] = use.get(x, 0) + 1
            return x

        def fitting(lengths: np.ndarray | list[int]) -> int | None:
            return next((int(x) for x in lengths if left[x] > use.get(int(x), 0)), None)

        room = capacity
        for k in config[:-1]:
            room -= put(fitting(members[k]))
        while room > small and (x := fitting(small + 1 + np.flatnonzero(left[small + 1 : room + 1])[::-1])) is not None:
            room -= put(x)
        n = min(int(left[x]) // m for x, m in use.items())
        runs.add(room, [(x, int(rank[x]) + j * n) for x, m in use.items() for j in range(m)], n)
        for x, m in use.items():
            rank[x] += n * m
            left[x] -= n * m
            there[of[x]] -= n * m
    _best_fit(runs, left, rank, small)
    return runs.all()


def _best_fit(runs: Runs, counts: np.ndarray, rank: np.ndarray, small: int) -> None:
    """The small lengths, longest first, each into the fullest sequences that still take it, else into new ones."""
    capacity = runs.capacity
    for x in range(min(small, len(counts) - 1), 0, -1):
        left = int(counts[x])
        while left:
            room = next((r for r in range(x, capacity + 1) if runs.free.get(r)), None)
            if room is None:
                slots, count, room = [], left, capacity
                count = -(-left // max(1, capacity // x))
            else:
                slots, count = runs.free[room].pop()
            each = room // x
            n = min(count, left // each) if left >= each else 0
            if n:
                rest = count - n
            else:  # fewer pieces than one sequence takes
                each, n, rest = left, 1, count - 1
            own = list(slots)
            for _ in range(each):
                own.append((x, int(rank[x])))
                rank[x] += n
            runs.add(room - each * x, own, n)
            if slots:
                runs.add(room, [(length, r + n) for length, r in slots], rest)
            left -= each * n


def _lookup(runs: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, the sequence of the first rank, and the offset."""
    out: dict[int, list] = {}
    base = 0
    for slots, count in runs:
        at = 0
        for x, first in slots:
            out.setdefault(x, []).append((first, base, at))
            at += x
        base += count
    return {x: tuple(np.array(v, np.int64) for v in zip(*sorted(rows), strict=True)) for x, rows in out.items()}


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, small: int = SMALL, n_groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) with sequence_id and offset. ``found`` must be a stored table.

    Ranks: pieces are dealt into parts by a hash of doc_id and piece, so no length is gathered anywhere; they are numbered
    within (part, length), and counts of (part, length) give the first rank of each. What goes to the driver is the
    histogram, ``capacity`` rows at most, and what is sent to the tasks the plan, whose runs each use up a length or a size.
    """
    spark = found.sparkSession
    dealt = found.withColumn("part", F.pmod(F.hash("doc_id", "piece"), F.lit(c.partitions(spark))))
    counts = c.written(dealt.groupBy("part", "length").agg(F.count("*").alias("n")), c.shared_dir(spark), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_lookup(plan(histogram, capacity, small, n_groups)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("rank", inside).join(first.hint("merge"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("rank") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, begin = np.unique(length[order], return_index=True)
            for x, at in zip(values.tolist(), np.split(order, begin[1:]), strict=True):
                firsts, base, off = lookup[x]
                run = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at] = base[run] + rank[at] - firsts[run]
                offset[at] = off[run]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    Null and empty texts are a piece of the end id alone; very long texts are cut whole. Repeated rows, and rows of one or no
    doc_id, are packed as often as they occur.
    """
    found = c.written(pieces(documents, path, capacity), c.shared_dir(documents.sparkSession), "pieces")
    return pack_pieces(found, capacity)
