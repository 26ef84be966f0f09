"""N-gram Jaccard join by vertical partitioning.

All shingles of the corpus are put in one global order, rare ones first, and the order is cut into fragments: ranges of it.
Each document sends the shingles of its prefix (those of which two similar documents must share one) to their fragments; a
fragment counts partial overlaps of the pairs it sees, and sums over the fragments decide which pairs can reach the
threshold. Those are verified on their words. Equal sets are one class from the start. Where many classes meet in a shingle
only links to the least class, and to neighbours of like size, are counted; classes that these links leave apart are then
paired across components, in blocks of a list, so no group costs all its pairs, none is one task, and no link is lost.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c
from netmetrics.llm.components import components

#: Five words, and 75 hundredths; fixed by the contract.
N, PERCENT = 5, 75
#: Counters of the global order: 2**SKETCH, each over all documents; more of them only make the order finer.
SKETCH, SKETCH_BLOCKS = 22, 64
#: Classes in a shingle's list of which all pairs are counted at once.
SMALL_LIST = 12
#: Partners, by list, of a class that the first links left apart, before all its partners are looked at.
FEW = 48
#: At most so many turns of that.
TURNS = 2
#: Entries of a long list that meet as many others in one task; a longer one is dealt out in blocks.
SPLIT = 256
#: Prefix shingles of a fragment, about; most of them lie in the first HEAD of the order, by mass.
ENTRIES, HEAD = 125_000, 0.3
#: Bits of a class's parity bitmap, which bounds overlaps from above; larger sets are pruned less, never wrongly.
BITS = 2048
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all documents of a block, by document, and where each document's begin (n + 1)."""
    low = c.LOWER[data]
    starts, ends, begin = c.words(low, off, c.NOT_SPACE)
    h = c.word_hashes(low, starts, ends)
    n_words, docs = np.diff(begin), len(off) - 1
    doc = np.repeat(np.arange(docs), n_words)
    g = c.gram_hashes(h, n)
    inside = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    own = [c.gram_hashes(h[begin[d] : begin[d + 1]], int(n_words[d])) + c.U64(1) for d in short]
    g = np.concatenate([g[inside], *own])
    d = np.concatenate([doc[: len(inside)][inside], short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(docs + 1))


def set_hashes(g: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (c.U64(0x1234567), c.U64(0xABCDEF123)):
        run = np.concatenate([np.zeros(1, c.U64), np.cumsum(c.mixed(g ^ salt), dtype=c.U64)])
        out.append((run[begin[1:]] - run[begin[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (size and hashes of its set), and the task's counters in compressed blocks."""
    count, seen = np.zeros(1 << SKETCH, np.uint32), False
    for b in c.blocks(batches):
        g, begin = shingles(*c.utf8(b.column("text")))
        np.add.at(count, (g >> c.U64(64 - SKETCH)).astype(np.int64), 1)
        seen = True
        s1, s2 = set_hashes(g, begin)
        m = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(s1), pa.array(s2), pa.array(np.diff(begin).astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], _SETS)
    if seen:
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [pack(x.tobytes()) for x in np.split(count, SKETCH_BLOCKS)]
        m = len(rows)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array(range(m), pa.int32()), pa.array(rows, pa.binary())], _SETS)


_SETS = ["k", "s1", "s2", "n", "block", "counts"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32)
            total[k] = total.get(k, 0) + x.astype(np.uint64)
    for k, x in total.items():
        level = np.minimum(255, np.floor(8 * np.log2(1.0 + x))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "level"])


def order_levels(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are, over all documents: 2**SKETCH bytes."""
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH) // SKETCH_BLOCKS), np.uint8)
    df = sets.where("block is not null").select("block", "counts").repartition("block")
    for r in df.mapInArrow(_summed, "block int, level binary").toLocalIterator():
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.ravel()


def order_key(g: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The place of a shingle in the global order, as a number: how common it is, then its hash."""
    return (level.astype(c.U64) << c.U64(56)) | (g >> c.U64(8))


def order_cuts(level: np.ndarray, fragments: int) -> np.ndarray:
    """Keys at which the order is cut: ranges of even mass, four fifths of them in the order's first HEAD, where prefixes are."""
    at = np.argsort(level, kind="stable")
    mass = np.cumsum(np.exp2(level[at] / 8.0) - 1 + 1e-9)
    x = np.arange(1, fragments) / fragments
    share = np.where(x <= 0.8, x / 0.8 * HEAD, HEAD + (x - 0.8) / 0.2 * (1 - HEAD))
    cut = at[np.minimum(np.searchsorted(mass, share * mass[-1]), len(at) - 1)]
    return np.sort(order_key(cut.astype(c.U64) << c.U64(64 - SKETCH), level[cut]))


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + 1


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least intersection of two sets of these sizes that are similar enough."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def _prefixes(shared, fragments: int):
    """A row for each fragment and block: its shingles, with class, size and place in the document's order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, cuts), pack = shared.value, zstandard.ZstdCompressor(level=1).compress
        told: set[tuple[int, int]] = set()
        for b in c.blocks(batches, limit=2 * c.BLOCK):
            g, begin = shingles(*c.utf8(b.column("text")))
            s1, s2 = set_hashes(g, begin)
            n = np.diff(begin)
            doc = np.repeat(np.arange(len(n)), n)
            key = order_key(g, level[(g >> c.U64(64 - SKETCH)).astype(np.int64)])
            order = np.lexsort((g, key, doc))
            g, key = g[order], key[order]
            place = np.arange(len(g)) - begin[doc]
            new = np.zeros(len(n), bool)
            for d, pair in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if pair not in told:
                    told.add(pair)
                    new[d] = n[d] > 0
            if len(told) > 200_000:
                told.clear()
            use = (place < prefix_size(n)[doc]) & new[doc]
            g, doc, place = g[use], doc[use], place[use]
            to = np.searchsorted(cuts, key[use], "right")
            order = np.lexsort((g, to))
            ends = np.searchsorted(to[order], np.arange(fragments + 1))
            rows = []
            for k in range(fragments):
                own = order[ends[k] : ends[k + 1]]
                if len(own):
                    known, ref = np.unique(doc[own], return_inverse=True)
                    raw = b"".join(x.tobytes() for x in (np.diff(g[own], prepend=c.U64(0)), ref.astype(np.uint32), place[own].astype(np.uint32), s1[known], n[known].astype(np.uint32)))
                    rows.append((k, len(own), len(known), pack(raw)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["fragment", "entries", "docs", "packed"])

    return scan


def _lists(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def can_link(na, pa_, nb, pb) -> np.ndarray:
    """Whether sets can be similar whose first common shingle is at these places of their orders."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= PERCENT * large) & (np.minimum(na - pa_, nb - pb) >= needed(na, nb))


_FOUND = ["kind", "a", "b", "na", "nb", "x", "key"]
FOUND = "kind int, a long, b long, na long, nb long, x long, key long"


def _found(kind: int, a, b=None, na=None, nb=None, x=None, key=None) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *(pa.nulls(m, pa.int64()) if v is None else pa.array(np.asarray(v).astype(np.int64)) for v in (a, b, na, nb, x, key))], _FOUND)


def _count(batches: Iterator[pa.RecordBatch], short: int) -> Iterator[pa.RecordBatch]:
    """One fragment at a time (rows come sorted): partial overlaps (0), entries of long lists (1), how many a class has (2)."""
    at, parts = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["fragment"] != at and parts:
                yield from _fragment(parts, short)
                parts = []
            at = r["fragment"]
            raw = zstandard.ZstdDecompressor().decompress(r["packed"])
            m, d = r["entries"], r["docs"]
            g = np.cumsum(np.frombuffer(raw, c.U64, m), dtype=c.U64)
            ref, place = np.frombuffer(raw, np.uint32, 2 * m, 8 * m).reshape(2, m)
            cid, n = np.frombuffer(raw, np.int64, d, 16 * m), np.frombuffer(raw, np.uint32, d, 16 * m + 8 * d)
            parts.append((g, cid[ref], n[ref].astype(np.int64), place.astype(np.int64)))
    if parts:
        yield from _fragment(parts, short)


def _fragment(parts: list[tuple], short: int) -> Iterator[pa.RecordBatch]:
    g, cid, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cid, g))
    g, cid, n, place = g[order], cid[order], n[order], place[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (cid[1:] != cid[:-1])  # copies of a class from several tasks
    g, cid, n, place = g[keep], cid[keep], n[keep], place[keep]
    start, size = _lists(g)
    left, right, ok = [], [], []
    for m in range(2, short + 1):
        s = start[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                left.append(s + i)
                right.append(s + j)
    long_ = size > short
    entry = np.repeat(long_, size)
    if entry.any():
        center = np.repeat(start, size)
        own = np.flatnonzero(entry & (np.arange(len(g)) != center))
        left.append(center[own])
        right.append(own)
        # and to a neighbour of like size, another one in each list, so that what is not near the least class is near others
        rung = np.floor(np.log(n[entry]) / np.log(100 / PERCENT) * 2).astype(np.int64)
        line = np.flatnonzero(entry)[np.lexsort((c.mixed(cid[entry].view(c.U64) ^ g[entry]), rung, g[entry]))]
        x, y = line[:-1][g[line][1:] == g[line][:-1]], line[1:][g[line][1:] == g[line][:-1]]
        left.append(np.where(cid[x] < cid[y], x, y))
        right.append(np.where(cid[x] < cid[y], y, x))
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        ok = can_link(n[i], place[i], n[j], place[j])
        order = np.lexsort((cid[j], cid[i]))
        i, j, ok = i[order], j[order], ok[order]
        if len(i):
            new = np.flatnonzero(np.concatenate([[True], (cid[i][1:] != cid[i][:-1]) | (cid[j][1:] != cid[j][:-1])]))
            count = np.diff(np.append(new, len(i)))
            hope = np.add.reduceat(ok.astype(np.int64), new) > 0
            yield _found(0, cid[i][new], cid[j][new], n[i][new], n[j][new], count, hope)
    if entry.any():
        yield _found(1, cid[entry], None, n[entry], None, place[entry], g[entry].view(np.int64))
        who, many = np.unique(cid[entry], return_counts=True)
        yield _found(2, who, x=many)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first hash and the size of each document's set, and of each of BITS bits whether an odd number of its shingles falls on it."""
    for b in c.blocks(batches):
        g, begin = shingles(*c.utf8(b.column("text")))
        docs = len(begin) - 1
        odd = np.zeros(docs * BITS, np.uint8)
        np.bitwise_xor.at(odd, np.repeat(np.arange(docs), np.diff(begin)) * BITS + (c.mixed(g ^ c.U64(0x5EED)) % c.U64(BITS)).astype(np.int64), 1)
        rows = np.packbits(odd.reshape(docs, BITS), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(set_hashes(g, begin)[0]), pa.array(np.diff(begin).astype(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], ["a", "na", "bits"])


def _across(batches: Iterator[pa.RecordBatch], most: int = 0, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """Blocks of long lists: pairs of a class outside the list's largest component (side 0) and another (side 1) that no link
    has joined yet and that can still be similar.

    Bits in which two bitmaps differ are shingles that only one set has: pairs with too many of them are none.

    With ``most``, at most so many for each class of side 0 in a block, drawn by hash anew each turn.
    """
    held: list[tuple] = []
    at = None

    def pairs() -> Iterator[pa.RecordBatch]:
        side, cid, comp, n, place, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.flatnonzero(side == 1)
        order = order[np.argsort(n[order], kind="stable")]
        sizes = n[order]
        for i in np.flatnonzero(side == 0):
            j = order[np.searchsorted(sizes, -(-PERCENT * n[i] // 100), "left") : np.searchsorted(sizes, 100 * n[i] // PERCENT, "right")]
            j = j[(comp[j] != comp[i]) & can_link(n[i], place[i], n[j], place[j])]
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[n[i] + n[j] - differ >= 2 * needed(n[i], n[j])]
            if most and len(j) > most:
                j = j[np.argpartition(c.mixed((cid[j] ^ cid[i]).view(c.U64) + c.U64(turn)), most)[:most]]
            if len(j):
                yield _found(0, np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]))

    for b in batches:
        block = np.stack([b.column(x).to_numpy().astype(np.int64) for x in ("key", "row", "col")], 1)
        columns = [b.column(x).to_numpy() for x in ("side", "a", "component", "na", "x")]
        columns.append(np.frombuffer(b"".join(b.column("bits").to_pylist()), c.U64).reshape(-1, BITS // 64))
        start = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(1)])) if len(block) else []
        for s, z in zip(start, [*start[1:], len(block)], strict=True):
            if held and tuple(block[s]) != at:
                yield from pairs()
                held = []
            at = tuple(block[s])
            held.append(tuple(x[s:z] for x in columns))
    if held:
        yield from pairs()


def in_blocks(entries: DataFrame, split: int) -> DataFrame:
    """Entries (key, a, component, …) of lists with several components, dealt to blocks (key, row, col).

    Side 0 are the classes outside their list's largest component, in rows of blocks, each sent to every column; side 1 are
    all classes, in columns, each sent to every row. A block has about ``split`` of either, so a list costs its pairs with
    classes outside its largest component and no more; lists of one component cost nothing.
    """
    lists = entries.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    lists = lists.agg(F.sum("n").alias("m"), F.max(F.struct("n", "component")).alias("top")).where("m > top.n")
    lists = lists.select("key", F.col("top.component").alias("main"), F.ceil((F.col("m") - F.col("top.n")) / split).cast("int").alias("rows"), F.ceil(F.col("m") / split).cast("int").alias("cols"))
    own, hashed = entries.join(lists, "key"), F.xxhash64("a", "key")
    left = own.where("component != main").withColumn("side", F.lit(0)).withColumn("row", F.pmod(hashed, "rows").cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    right = own.withColumn("side", F.lit(1)).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.pmod(hashed, "cols").cast("int"))
    return left.unionByName(right).drop("main", "rows", "cols")


def word_set(text: str, n: int = N) -> set[tuple[str, ...]]:
    w = WORD.findall(text.translate(AZ))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = b.column("a").to_pylist(), b.column("b").to_pylist()
        ta, tb, out, last = b.column("ta"), b.column("tb"), [], (None, set())
        for i in range(b.num_rows):
            t = ta[i].as_py()
            if last[0] != t:  # a repeated id has several texts
                last = (t, word_set(t))
            x, y = last[1], word_set(tb[i].as_py())
            both = len(x & y)
            out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        ok = np.array(out, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(z, np.int64)[ok])], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of document keys whose word sets are similar enough. Texts of the documents in pairs only are sent on.

    All texts of a repeated key are tried, as they are one document.
    """
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    own = c.written(texts.join(ids.hint("shuffle_hash"), "k").dropDuplicates(["k", "text"]), folder, f"{name}-texts")
    both = pairs.join(own.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b").join(own.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a")
    return c.written(both.mapInArrow(_verified, "a long, b long").distinct(), folder, f"{name}-links")


def similar_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, near): (k, s1, s2, n) of each row; (s1, s2, n, rep) of each set; (node, component) of linked reps."""
    spark = documents.sparkSession
    folder, parts = c.shared_dir(spark), c.partitions(spark)
    texts = documents.select(c.key().alias("k"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    made = c.written(texts.mapInArrow(_sets, "k long, s1 long, s2 long, n long, block int, counts binary"), folder, "sets")
    level = order_levels(made)
    sets = made.where("block is null").select("k", "s1", "s2", "n")
    classes = c.written(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("k").alias("rep")), folder, "classes")
    entries = classes.agg(F.sum(F.expr(f"n - ceil({PERCENT} * n / 100.0D) + 1"))).first()[0] or 0
    fragments = max(4, parts // 2, int(entries) // ENTRIES)
    shared = spark.sparkContext.broadcast((level, order_cuts(level, fragments)))  # 2**SKETCH bytes, and a number for each fragment
    sent = texts.mapInArrow(_prefixes(shared, fragments), "fragment long, entries long, docs long, packed binary")
    found = c.written(sent.repartition(max(parts, fragments // 4), "fragment").sortWithinPartitions("fragment").mapInArrow(functools.partial(_count, short=SMALL_LIST), FOUND), folder, "found")
    partial = found.where("kind = 0").groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("x").alias("both"), F.max("key").alias("hope")).where("hope > 0")
    # a shingle of a long list may be common to a pair and not be counted: no pair has more of them than its poorer class
    more = found.where("kind = 2").groupBy("a").agg(F.sum("x").alias("more"))
    partial = partial.join(more.withColumnRenamed("more", "ma"), "a", "left").join(more.select(F.col("a").alias("b"), F.col("more").alias("mb")), "b", "left")
    suffix = F.expr(f"greatest(ceil({PERCENT} * na / 100.0D), ceil({PERCENT} * nb / 100.0D)) - 1")
    least = F.expr(f"ceil({PERCENT} * (na + nb) / {100 + PERCENT}.0D - 1e-9D)")
    hopeful = partial.where(F.col("both") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))) + suffix >= least).select("a", "b")
    rep = classes.select(F.col("s1").alias("a"), "rep")

    def by_rep(pairs: DataFrame) -> DataFrame:
        x = pairs.join(rep, "a").select(F.col("rep").alias("ra"), F.col("b").alias("a")).join(rep, "a")
        return x.select(F.least("ra", "rep").alias("a"), F.greatest("ra", "rep").alias("b")).distinct()

    links = verify(c.written(by_rep(hopeful), folder, "pairs"), texts, folder, "first")
    near = c.written(components(links, folder, "near"), folder, "near")
    if not found.where("kind = 1").isEmpty():
        some = found.where("kind = 2").select("a").join(rep, "a").select(F.col("rep").alias("k"))
        bits = texts.join(some.distinct(), "k", "left_semi").mapInArrow(_bits, "a long, na long, bits binary").dropDuplicates(["a"])
        # a long document has as many entries as its prefix is long: they meet its bitmap in slices of about SPLIT
        slices = F.expr(f"1 + cast((na - ceil({PERCENT} * na / 100.0D)) / {SPLIT} as int)")
        of = bits.join(rep, "a").select("a", "rep", "bits", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        entries = found.where("kind = 1").select("a", "na", "x", "key", F.pmod(F.xxhash64("key"), slices).cast("int").alias("slice"))
        entries = entries.join(c.written(of, folder, "bits"), ["a", "slice"])
        entries = c.written(entries.select(F.col("rep").alias("a"), "na", "x", "key", "bits"), folder, "entries")
        # a few partners of each class that is still apart, turn by turn, so that what belongs to a large component joins it;
        # then all pairs of classes whose components still differ
        turns = [(FEW, k) for k in range(1, TURNS + 1)] + [(0, 0)]
        while turns:
            most, turn = turns.pop(0)
            name = f"turn-{turn}"
            again = c.written(entries.join(near.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")), folder, f"{name}-at")
            again = in_blocks(again, SPLIT).repartition(parts, "key", "row", "col").sortWithinPartitions("key", "row", "col")
            pairs = again.mapInArrow(functools.partial(_across, most=most, turn=turn), FOUND).select("a", "b").distinct()
            pairs = c.written(pairs, folder, name)
            if pairs.isEmpty():
                break  # no two components meet in a list
            new = verify(pairs, texts, folder, name)
            if new.isEmpty():
                turns = turns[-1:] if most else []
            else:
                near = components(new, folder, f"{name}-near", near)
    return sets, classes, near


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents.

    Rows without words are components of their own. Rows that repeat a doc_id share it as one node of the graph. A null
    doc_id is the smallest; a component that has it shows null.
    """
    sets, classes, near = similar_classes(documents)
    folder = c.shared_dir(documents.sparkSession)
    if not sets.where("n > 0").groupBy("k").count().where("count > 1").isEmpty():
        # rows of one doc_id with different texts are one document: its classes hang together
        twice = sets.where("n > 0").join(classes, ["s1", "s2", "n"]).where("k != rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
        near = components(twice.select("a", "b").distinct(), folder, "all", near)
    of = classes.join(near, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = sets.join(of, ["s1", "s2", "n"], "left").withColumn("component", F.coalesce("component", "k"))
    null = F.lit(c.NULL_KEY)
    return out.select(F.when(F.col("k") != null, F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") != null, F.col("component")).alias("component_id"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents, all columns, without those that link, directly or not, to a document of smaller doc_id.

    Documents without words stay; rows that repeat a doc_id stay or go together; a null doc_id is the smallest and stays.
    """
    folder, name = c.shared_dir(documents.sparkSession), c.fresh(documents, "gone")
    found = c.written(near_duplicates(documents), folder, "components")
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col("doc_id") == F.col(name), "left_anti")
