"""Substring dedup over all documents with enhanced suffix arrays.

Every window of MIN_BYTES bytes belongs to the bucket of its minimizer, the least hash of the K-byte strings in it; equal
windows have equal minimizers. The windows of a document that choose the same minimizer are a run: consecutive starts, one
stretch of text. Stretches that are equal from end to end are settled by their hashes alone. The stretches that share a
minimizer and differ, where repeats begin, end or were edited, go with their text to their bucket, and there an enhanced
suffix array is built: suffixes sorted, common prefixes of neighbours, a stack-scan of the tree of common-prefix intervals,
and of its nodes those whose occurrences differ in the byte to the left are maximal repeats, with all their occurrences.
A repeat's first occurrence stays and the others go. Stretches of a minimizer that very many differing stretches share are
compared window by window instead, spread by the windows' hashes, so no bucket is gathered beyond BUCKET stretches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Fixed by the contract.
MIN_BYTES = 100
K = 24
#: Text of a numpy pass, and bits of a position in it.
BLOCK, PLACE_BITS = 2 << 20, 26
SEGMENT = 16 << 20
#: Differing stretches of a minimizer that one suffix array takes.
BUCKET = 3000


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64."""
    n = 1 << bits
    inverse = np.full(n, c.U64(pow(int(c.STEP), -1, 1 << 64)), c.U64)
    inverse[0] = 1
    return c.powers(n), np.multiply.accumulate(inverse)


class Hashes:
    """Hashes of any stretch of a buffer in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(max(12, int(len(data) + 1).bit_length()))
        self.run = np.zeros(len(data) + 1, c.U64)
        np.cumsum(c.BYTE[data] * up[: len(data)], out=self.run[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return c.mixed((self.run[end] - self.run[start]) * self.down[start])


def runs(data: np.ndarray, off: np.ndarray, length: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, minimizer's hash, hash of the stretch) of all runs of a block.

    Starts are in the block's bytes. Windows lie within one document.
    """
    n, w = len(data), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(c.U64), none.view(c.U64)
    hashes = Hashes(data)
    at = np.arange(n - K + 1)
    gram = c.mixed((hashes.run[K:] - hashes.run[: n - K + 1]) * hashes.down[: n - K + 1])
    low = c.U64((1 << PLACE_BITS) - 1)
    v = (gram & ~low) | at.astype(c.U64)
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < w:
        v = np.minimum(v[: len(v) - (w - span)], v[w - span :])
    least = (v & low).astype(np.int64)  # of the window that starts at each byte
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    inside = off[doc + 1] - np.arange(len(least)) >= length
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    stop = np.ones(len(least), bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    return doc[first], first, last, gram[least[first]], hashes(first, last + length)


def _segments(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A block, or the overlapping stretches of its one very long document, and where they begin."""
    if len(data) <= SEGMENT:
        yield data, off, 0
        return
    for at in range(0, len(data), SEGMENT):  # blocks() makes a block of this size of one document only
        part = data[at : at + SEGMENT + MIN_BYTES - 1]
        if len(part) >= MIN_BYTES:
            yield part, np.array([0, len(part)]), at


_ENTRY = np.dtype([("m", "<u8"), ("h", "<u8"), ("k", "<i8"), ("p", "<i8"), ("tag", "<i4"), ("n", "<i4")])


def _pack(tool: zstandard.ZstdCompressor, e: np.ndarray) -> bytes:
    """Column by column, sorted by m, so that what repeats in a column compresses."""
    docs, ref = np.unique(e[["k", "tag"]], return_inverse=True)
    columns = (np.diff(e["m"], prepend=c.U64(0)), e["h"], ref.astype("<u4"), e["p"].astype("<u4"), e["n"].astype("<u2"), docs["k"], docs["tag"])
    return tool.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in columns))


def _unpack(raw: bytes, n: int, docs: int) -> np.ndarray:
    raw, out, at = zstandard.ZstdDecompressor().decompress(raw), np.empty(n, _ENTRY), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    out["m"] = np.cumsum(take("<u8", n), dtype=np.uint64)
    out["h"] = take("<u8", n)
    ref = take("<u4", n)
    out["p"], out["n"] = take("<u4", n), take("<u2", n)
    out["k"], out["tag"] = take("<i8", docs)[ref], take("<i4", docs)[ref]
    return out


def _settled(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by (m, h, k, p, tag), one of each place: which are first of their stretch, and the sorted entries."""
    e = e[np.lexsort((e["tag"], e["p"], e["k"], e["h"], e["m"]))]
    same = np.zeros(len(e), bool)
    same[1:] = (e["m"][1:] == e["m"][:-1]) & (e["h"][1:] == e["h"][:-1])
    again = np.zeros(len(e), bool)
    again[1:] = same[1:] & (e["k"][1:] == e["k"][:-1]) & (e["p"][1:] == e["p"][:-1]) & (e["tag"][1:] == e["tag"][:-1])
    e, same = e[~again], same[~again]
    return ~same, e


#: A row of entries: of stretches to compare (kind 0), or of such as an equal stretch before them already covers (1).
SENT = "fragment int, kind int, entries int, docs int, packed binary"


def _sent(fragment: int, kind: int, e: np.ndarray, tool) -> tuple:
    return fragment, kind, len(e), len(np.unique(e[["k", "tag"]])), _pack(tool, e)


def _stretches(fragments: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, turn = zstandard.ZstdCompressor(level=1), 0
        for b in c.blocks(batches, limit=BLOCK):
            keys, tags = b.column("k").to_numpy(), b.column("tag").to_numpy()
            for data, off, base in _segments(*c.utf8(b.column("text"))):
                doc, first, last, m, h = runs(data, off)
                if not len(doc):
                    continue
                e = np.empty(len(doc), _ENTRY)
                e["m"], e["h"], e["k"], e["tag"], e["n"] = m >> c.U64(16), h >> c.U64(8), keys[doc], tags[doc], last - first
                e["p"] = first - off[doc] + base
                lead, e = _settled(e)
                rows, to = [], (e["m"] % c.U64(fragments)).astype(np.int64)
                for k in np.unique(to[lead]):
                    rows.append(_sent(k, 0, e[lead & (to == k)], tool))
                if not lead.all():
                    turn += 1
                    rows.append(_sent((int(e["m"][0]) + turn) % fragments, 1, e[~lead], tool))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["fragment", "kind", "entries", "docs", "packed"])

    return scan


MARKS = "k long, tag int, kind int, m long, p long, n int"
#: Kinds of marks: the stretch goes; its windows are to be compared in a suffix array; or by their hashes.
GONE, BUCKETED, SPREAD = 0, 1, 2


def _marks(e: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e["k"]), pa.array(e["tag"]), pa.array(kind.astype(np.int32)), pa.array(e["m"].astype(np.int64)), pa.array(e["p"]), pa.array(e["n"])], ["k", "tag", "kind", "m", "p", "n"])


def _compare(bucket: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        for b in batches:
            for f, kind, n, docs, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind == 1:
                    e = _unpack(raw, n, docs)
                    yield _marks(e, np.zeros(len(e)))
                    continue
                if f != at and held:
                    yield _fragment(held, bucket)
                    held = []
                at = f
                held.append(_unpack(raw, n, docs))
        if held:
            yield _fragment(held, bucket)

    return scan


def _fragment(held: list[np.ndarray], bucket: int) -> pa.RecordBatch:
    lead, e = _settled(np.concatenate(held))
    group = np.cumsum(np.concatenate([[True], e["m"][1:] != e["m"][:-1]])) - 1
    kinds = np.bincount(group, weights=lead).astype(np.int64)[group]  # differing stretches of the minimizer
    kind = np.where(~lead, GONE, np.where(kinds > bucket, SPREAD, BUCKETED))
    use = ~lead | (kinds > 1)
    return _marks(e[use], kind[use])


def interval_tree(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack-scan of the common prefixes of neighbours in a suffix array: its maximal repeats.

    lcp[i]: of suffixes i - 1 and i (lcp[0] = 0). left[i]: the byte before suffix i, negative where there is none or where
    it is unknown (then it differs from any other). Yields (length, first, last) of each interval of at least ``least``
    common bytes whose members do not all have the same byte before them: every occurrence of a repeat that can be
    extended neither to the right nor to the left.
    """
    stack: list[list] = []  # length, first, the byte before all members so far or None
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first, mark = i - 1, left[i - 1] if left[i - 1] >= 0 else None
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            own = own if own == mark else None
            if own is None and length >= least:
                yield length, first, i - 1
            mark = own
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == mark else None
            else:
                stack.append([now, first, mark])
        else:
            stack.clear()


def repeats(bucket: np.ndarray, data: np.ndarray, off: np.ndarray, length: int = MIN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats among the stretches of each bucket: (length, stretches, starts inside them), all occurrences.

    The suffixes are the window starts of the stretches. They are ordered by bucket and by (the hash of) their first
    ``length`` bytes, then byte by byte: only that their first ``length`` bytes stand together matters for intervals of
    that length and more. Groups of one suffix, and groups that one byte precedes throughout, have no maximal repeats.
    """
    windows = np.diff(off) - length + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    s, hashes = off[owner] + inner, Hashes(data)
    key = hashes(s, s + length) ^ c.mixed(bucket[owner].astype(c.U64) + c.STEP)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(order)))
    left = np.where(inner > 0, data[s - 1].astype(np.int64), -1)[order]
    low, high = np.minimum.reduceat(left, start) if len(start) else left, np.maximum.reduceat(left, start) if len(start) else left
    use = np.repeat((size > 1) & ((low < 0) | (low != high)), size)
    sa, left, group = order[use], left[use], np.repeat(np.arange(len(size)), size)[use]
    if not len(sa):
        return
    lcp = _order(sa, left, group, s, off[owner + 1], data, length)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, z in zip(begin, np.append(begin[1:], len(group)), strict=True):
        members = sa[a:z]
        for n, first, last in interval_tree(lcp[a:z].tolist(), left[a:z].tolist(), length):
            own = members[first : last + 1]
            yield n, owner[own], inner[own]


def _order(sa: np.ndarray, left: np.ndarray, group: np.ndarray, s: np.ndarray, end: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Sorts the suffixes of each group (in place) by what follows their first ``depth`` bytes; common prefixes of neighbours."""
    lcp = np.zeros(len(sa), np.int64)
    rank, slots, padded = group.copy(), np.arange(len(sa)), np.concatenate([data, np.zeros(16, np.uint8)])
    while len(slots):
        at, stop = s[sa[slots]] + depth, end[sa[slots]]
        valid = np.clip(stop - at, 0, 7)
        k = np.zeros(len(slots), c.U64)
        for j in range(7):
            k = (k << c.U64(8)) | np.where(j < valid, padded[np.minimum(at + j, len(data))], 0).astype(c.U64)
        k = (k << c.U64(8)) | valid.astype(c.U64)
        o = np.lexsort((k, rank[slots]))
        sa[slots], left[slots], k = sa[slots][o], left[slots][o], k[o]
        r = rank[slots]  # ranks of a group are equal and stand together, so they are in place
        pair = r[1:] == r[:-1]
        split = np.concatenate([[True], ~pair | (k[1:] != k[:-1])])
        differ = (k[1:] ^ k[:-1]) >> c.U64(8)
        common = np.full(len(differ), 7, np.int64)
        for j in range(7):
            common = np.where((common == 7) & ((differ >> c.U64(8 * (6 - j))) & c.U64(255) > 0), j, common)
        v = (k & c.U64(255)).astype(np.int64)
        common = np.minimum(common, np.minimum(v[1:], v[:-1]))
        new = np.where(pair & (split[1:] | (v[1:] < 7)), depth + common, 0)
        lcp[slots[1:]] = np.where(new > 0, new, lcp[slots[1:]])
        part = np.cumsum(split) - 1
        rank[slots] = slots[np.flatnonzero(split)][part] + len(data)
        slots = slots[(np.bincount(part)[part] > 1) & (v == 7)]
        depth += 7
    return lcp


def _united(k: np.ndarray, tag: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes of each document in as few intervals as can be: nested and overlapping repeats are one."""
    order = np.lexsort((p, tag, k))
    k, tag, p, end = k[order], tag[order], p[order], (p + n)[order]
    doc = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (tag[1:] != tag[:-1])])) * (int(end.max(initial=0)) + 1)
    far = np.maximum.accumulate(end + doc)
    first = np.flatnonzero(np.concatenate([[True], p[1:] + doc[1:] > far[:-1]]))
    last = np.append(first[1:], len(p)) - 1
    return k[first], tag[first], p[first], (far - doc)[last] - p[first]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, k, tag, p, text) sorted by key: stretches of a bucket with their text, or single windows without.

    Returns what goes: (k, tag, p, n), n bytes from p of the document on.
    """
    held: list[tuple] = []
    size, at = 0, None

    def settle() -> Iterator[pa.RecordBatch]:
        key, k, tag, p, text = zip(*held, strict=True)
        key, k, tag, p = (np.array(x, np.int64) for x in (key, k, tag, p))
        out: list[tuple] = []
        single = np.array([t is None for t in text])
        if single.any():
            i = np.flatnonzero(single)
            i = i[np.lexsort((tag[i], p[i], k[i], key[i]))]
            i = i[1:][key[i][1:] == key[i][:-1]]
            out.append((k[i], tag[i].astype(np.int32), p[i], np.full(len(i), MIN_BYTES)))
        whole = np.flatnonzero(~single)
        if len(whole):
            off = np.cumsum([0, *(len(text[i]) for i in whole)])
            data = np.frombuffer(b"".join(text[i] for i in whole), np.uint8)
            for n, who, inner in repeats(key[whole], data, off):
                i = whole[who]
                begin = p[i] + inner
                o = np.lexsort((tag[i], begin, k[i]))[1:]  # the first occurrence stays
                out.append((k[i][o], tag[i][o].astype(np.int32), begin[o], np.full(len(o), n)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _united(*(np.concatenate(x) for x in zip(*out, strict=True)))], ["k", "tag", "p", "n"])

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if row[0] != at and (size > BLOCK // 2 or len(held) > 200_000):
                yield from settle()
                held, size = [], 0
            at = row[0]
            held.append(row)
            size += len(row[4] or b"")
    if held:
        yield from settle()


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the intervals cover; touching intervals are one run."""
    out: list[list[int]] = []
    for a, z in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


_CUT = "k long, tag int, doc_id long, text binary, gone array<struct<p:long,n:long>>, windows array<struct<key:long,p:long,text:binary>>"
_LIST = pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))
_WINDOWS = pa.list_(pa.struct([("key", pa.int64()), ("p", pa.int64()), ("text", pa.binary())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their marks: what goes as intervals, what is to be compared as stretches or windows of text."""
    for b in c.blocks(batches):
        texts = b.column("text").to_pylist()
        gone, windows, raws, local = [], [], [], {}
        keys, tags = b.column("k").to_pylist(), b.column("tag").to_pylist()
        for d, (text, marks) in enumerate(zip(texts, b.column("marks").to_pylist(), strict=True)):
            raw = (text or "").encode("utf-8", "replace")
            own: list[dict] = []
            windows.append(own)
            raws.append(raw)
            lost = [(x["p"], x["p"] + x["n"] + MIN_BYTES) for x in marks or () if x["kind"] == GONE]
            gone.append(lost)
            for x in marks or ():
                if x["kind"] == BUCKETED:
                    own.append({"key": x["m"], "p": x["p"], "text": raw[x["p"] : x["p"] + x["n"] + MIN_BYTES]})
                elif x["kind"] == SPREAD:
                    data = np.frombuffer(raw, np.uint8, x["n"] + MIN_BYTES, x["p"])
                    h, at = Hashes(data), np.arange(x["n"] + 1)
                    for j, w in enumerate(h(at, at + MIN_BYTES).view(np.int64).tolist()):
                        place = (keys[d], x["p"] + j, tags[d], d)
                        first = min(place, local.get(w, place))  # what a block sees twice goes here and now
                        for other in {place, local.get(w, place)} - {first}:
                            if other[:3] != first[:3]:
                                gone[other[3]].append((other[1], other[1] + MIN_BYTES))
                        local[w] = first
        for w, (_, p, _, d) in local.items():
            windows[d].append({"key": w, "p": p, "text": None})
        lists = [[{"p": a, "n": z - a} for a, z in merged(x)] for x in gone]
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("tag"), b.column("doc_id"), pa.array(raws, pa.binary()), pa.array(lists, _LIST), pa.array(windows, _WINDOWS)], ["k", "tag", "doc_id", "text", "gone", "windows"])


def repeated_bytes(documents: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, gone, more): of each row the intervals that go, from equal stretches and from repeats."""
    spark = documents.sparkSession
    folder, parts = c.shared_dir(spark), c.partitions(spark)
    own = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"), c.key().alias("k"))
    twice = not own.groupBy("k").count().where("count > 1").isEmpty()
    # rows that share a doc_id are told apart by their text
    own = own.withColumn("tag", F.hash("text") if twice else F.lit(0))
    sent = own.select("k", "tag", "text").mapInArrow(_stretches(parts), SENT)
    marks = sent.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(_compare(BUCKET), MARKS)
    lists = marks.groupBy("k", "tag").agg(F.collect_list(F.struct("kind", "m", "p", "n")).alias("marks"))
    cut = c.written(own.join(lists, ["k", "tag"], "left").select("k", "tag", "doc_id", "text", "marks").mapInArrow(_cut, _CUT), folder, "cut")
    del sent, marks, lists
    c.release(spark)
    windows = cut.where(F.size("windows") > 0).select("k", "tag", F.explode("windows").alias("w")).select(F.col("w.key").alias("key"), "k", "tag", F.col("w.p").alias("p"), F.col("w.text").alias("text"))
    found = windows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_windows, "k long, tag int, p long, n long")
    more = found.groupBy("k", "tag").agg(F.collect_list(F.struct("p", "n")).alias("more"))
    # only documents with something to compare meet their findings; the others are done
    base = cut.select("k", "tag", "doc_id", "text", "gone", (F.size("windows") > 0).alias("open"))
    closed = base.where(~F.col("open")).select("doc_id", "text", "gone", F.lit(None).cast("array<struct<p:long,n:long>>").alias("more"))
    return base.where("open").join(more, ["k", "tag"], "left").select("doc_id", "text", "gone", "more").unionByName(closed)


def substring_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents.

    Null and empty texts, and texts under MIN_BYTES bytes, keep all. Of rows with the same doc_id and text all keep what
    none before them holds; rows with the same doc_id and different texts go by start, then by text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, gone, more in zip(*(b.column(x).to_pylist() for x in ("text", "gone", "more")), strict=True):
                spans = merged([(x["p"], x["p"] + x["n"]) for x in (gone or []) + (more or [])])
                kept = b"".join(raw[a:z] for a, z in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(spans), c.hex_sha256(kept)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_bytes(documents).mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
