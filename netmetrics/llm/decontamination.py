"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a block of whole documents. Its words become ids of the benchmark's vocabulary (0: any other word), its
suffixes, cut at the longest benchmark item, are sorted into a suffix array, and every suffix of every benchmark text is
binary-searched in it. Suffixes whose first words begin nothing in the benchmark can't match and are not sorted.
Documents never meet in a shuffle; the benchmark goes to the tasks in blocks of a checked size, one pass for each block,
and what a block of several hits is stored in the shared folder before the next is read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text that go to the tasks at once.
QUERY_BLOCK = 16 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
HITS = "k long, digest string, block int, bits binary, items array<string>, longest long"


@dataclass
class Queries:
    """Benchmark texts made ready: the vocabulary's hashes, each text as word ids, and the distinct windows."""

    vocabulary: np.ndarray
    bits: int
    texts: list[np.ndarray]
    windows: np.ndarray  # word ids, padded with 0
    width: np.ndarray
    items: list[list[str]]  # of each window
    following: list[list[tuple[int, int]]]  # (text, place) of each window
    lead: np.ndarray  # hashes of the first words of all windows
    lead_n: int
    depth: int


def prepare(items: list[tuple[object, str | None]], n: int = 10) -> Queries:
    """Null ids are no items; rows that repeat an id are one item with several texts."""
    names, texts, vocabulary = [], [], {}
    for name, text in items:
        found = WORD.findall((text or "").encode("utf-8", "replace").lower())
        if name is not None and found:
            names.append(str(name))
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64))
    keys = list(vocabulary)
    raw = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64) if keys else np.zeros(0, np.int64)
    hashes = c.word_hashes(raw, ends - np.diff(ends, prepend=0), ends)
    order = np.argsort(hashes)
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(1, len(order) + 1)
    texts = [new[t] for t in texts]
    seen: dict[bytes, int] = {}
    windows, of, following = [], [], []
    for k, (name, t) in enumerate(zip(names, texts, strict=True)):
        for at in range(max(1, len(t) - n + 1)):
            w = t[at : at + n]
            i = seen.setdefault(w.tobytes(), len(windows))
            if i == len(windows):
                windows.append(w)
                of.append([])
                following.append([])
            if name not in of[i][-1:]:
                of[i].append(name)
            following[i].append((k, at))
    width = np.array([len(w) for w in windows], np.int64)
    padded = np.zeros((len(windows), n), np.int64)
    for i, w in enumerate(windows):
        padded[i, : len(w)] = w
    lead_n = int(min(3, width.min(initial=3)))
    lead = np.unique(_lead(padded, lead_n)) if windows else np.zeros(0, c.U64)
    bits = max(1, int(len(keys)).bit_length())
    return Queries(hashes[order], bits, texts, padded, width, of, following, lead, lead_n, max([n, *map(len, texts)]))


def _lead(rows: np.ndarray, n: int) -> np.ndarray:
    p = c.powers(n)
    return c.mixed(sum(rows[:, j].astype(c.U64) * p[j] for j in range(n)))


class SuffixArray:
    """The sorted suffixes of one shard's word ids that start at ``at``; id 0 ends a suffix."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, bits: int, depth: int) -> None:
        self.per = max(1, 63 // bits)
        self.bits, self.ids = bits, np.concatenate([ids, np.zeros(self.per + 1, ids.dtype)])
        self.last = len(ids)
        sa, rank, slots, d = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(slots) and d < depth:
            k, ended = self.packed(sa[slots], d)
            order = np.lexsort((k, rank[slots]))
            sa[slots], k, ended, r = sa[slots][order], k[order], ended[order], rank[slots]
            new = np.ones(len(slots), bool)
            new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            group = np.cumsum(new) - 1
            rank[slots] = slots[np.flatnonzero(new)][group]
            slots = slots[(np.bincount(group)[group] > 1) & ~ended]
            d += self.per
        self.sa = sa

    def packed(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``per`` ids from ``depth`` on as one number, zeros after the first 0; whether there was one."""
        out, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(self.per):
            w = self.ids[np.minimum(at + depth + j, self.last)]
            alive &= w > 0
            out = (out << self.bits) | np.where(alive, w, 0)
        return out, ~alive

    def narrow(self, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, depth: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: the part of each [lo, hi) whose next n ids are ``key`` (packed, n ids)."""
        shift = self.bits * (self.per - n)
        out = []
        for strict in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                k = self.packed(self.sa[np.minimum(mid, len(self.sa) - 1)], depth)[0] >> shift
                less = (k <= key) if strict else (k < key)
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            out.append(a)
        return out[0], out[1]

    def find(self, rows: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (ids, padded with 0) of ``width`` ids the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.sa), np.int64)
        for d in range(0, rows.shape[1], self.per):
            for n in range(1, self.per + 1):
                q = np.flatnonzero((np.minimum(width - d, self.per) == n) & (lo < hi))
                if len(q):
                    k = np.zeros(len(q), np.int64)
                    for j in range(n):
                        k = (k << self.bits) | rows[q, d + j]
                    lo[q], hi[q] = self.narrow(lo[q], hi[q], k, d, n)
        return lo, hi


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the range that each is of."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def scan_block(data: np.ndarray, off: np.ndarray, q: Queries) -> dict:
    """One shard: its words, which of them are hit, the (document, item) pairs and each document's longest match."""
    n_docs = len(off) - 1
    low = c.LOWER[data]
    starts, ends, begin = c.words(low, off, c.ALNUM)
    n_words = np.diff(begin)
    found = {"n_words": n_words, "hit": np.zeros(len(starts), bool), "begin": begin, "pairs": [], "longest": np.zeros(n_docs, np.int64), "places": []}
    if not len(q.windows) or not len(starts):
        return found
    h = c.word_hashes(low, starts, ends)
    at = np.minimum(np.searchsorted(q.vocabulary, h), len(q.vocabulary) - 1)
    known = np.where(q.vocabulary[at] == h, at + 1, 0)
    doc = np.repeat(np.arange(n_docs), n_words)
    place = np.arange(len(starts)) + doc  # a 0 between documents
    ids = np.zeros(len(starts) + n_docs + 1, np.int64)
    ids[place] = known
    word_of = np.zeros(len(ids), np.int64)
    word_of[place] = np.arange(len(starts))
    cand = np.flatnonzero(ids > 0)
    cand = cand[cand + q.lead_n <= len(ids)]
    lead = _lead(ids[cand[:, None] + np.arange(q.lead_n)], q.lead_n)
    near = q.lead[np.minimum(np.searchsorted(q.lead, lead), len(q.lead) - 1)]
    cand = cand[near == lead]
    if not len(cand):
        return found
    array = SuffixArray(ids, cand, q.bits, q.depth)
    lo, hi = array.find(q.windows, q.width)
    cover = np.zeros(len(starts) + 1, np.int64)
    owner, at = spread(lo, hi)
    p = word_of[array.sa[at]]
    np.add.at(cover, p, 1)
    np.add.at(cover, p + q.width[owner], -1)
    for pair in np.unique(owner * n_docs + doc[p]):
        found["pairs"] += [(pair % n_docs, name) for name in q.items[pair // n_docs]]
    met = [(i, k, place) for i in np.unique(owner) for k, place in q.following[i]]  # suffixes of the benchmark that begin with a window
    if met:
        i, text, place = np.array(met, np.int64).T
        begins = np.cumsum([0, *map(len, q.texts)])
        flat, left = np.concatenate([*q.texts, [0]]), (begins[1:] - begins[:-1])[text] - place
        a, z, n, open_ = lo[i], hi[i], q.width[i].copy(), np.arange(len(i))
        while len(open_ := open_[n[open_] < left[open_]]):
            x, y = array.narrow(a[open_], z[open_], flat[(begins[text] + place + n)[open_]], n[open_], 1)
            more = x < y
            open_, x, y = open_[more], x[more], y[more]
            for from_, to in ((a[open_], x), (y, z[open_])):  # places that match no further
                owner, at = spread(from_, to)
                np.maximum.at(found["longest"], doc[word_of[array.sa[at]]], n[open_][owner])
            a[open_], z[open_] = x, y
            n[open_] += 1
        owner, at = spread(a, z)
        p = word_of[array.sa[at]]
        np.maximum.at(found["longest"], doc[p], n[owner])
        found["places"] = (text[owner], place[owner], n[owner], doc[p], p - begin[doc[p]])
    found["hit"] = np.cumsum(cover[:-1]) > 0
    return found


def _result(doc_ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list[set], longest: np.ndarray) -> pa.RecordBatch:
    digest = [c.hex_sha256(",".join(sorted(x)).encode()) for x in items]
    columns = [doc_ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0, pa.bool_()), pa.array(longest, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])


def _met(f: dict, n: int) -> list[set]:
    items: list[set] = [set() for _ in range(n)]
    for d, name in f["pairs"]:
        items[d].add(name)
    return items


def _whole(q: Queries):
    """The result of a benchmark that is one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.blocks(batches):
            f = scan_block(*c.utf8(b.column("text")), q)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(f["hit"])])[f["begin"]])
            yield _result(b.column("doc_id"), f["n_words"], n_hit, _met(f, b.num_rows), f["longest"])

    return scan


def _hits(q: Queries, block: int):
    """What a block of the benchmark hits, of the rows that it hits: a bit for each word, items and the longest match."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.blocks(batches):
            f = scan_block(*c.utf8(b.column("text")), q)
            items = _met(f, b.num_rows)
            rows = [k for k in range(b.num_rows) if items[k]]
            if rows:
                bits = [np.packbits(f["hit"][f["begin"][k] : f["begin"][k + 1]]).tobytes() for k in rows]
                own = b.select(["k", "digest"]).take(pa.array(rows))
                columns = [*own.columns, pa.array([block] * len(rows), pa.int32()), pa.array(bits, pa.binary()), pa.array([sorted(items[k]) for k in rows]), pa.array(f["longest"][rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "digest", "block", "bits", "items", "longest"])

    return scan


def _stored_hits(documents: DataFrame, blocks: Iterator[list[tuple]], window: int) -> DataFrame:
    """(k, digest, block, bits, items, longest): a pass over the documents for each block, its hits kept in the shared folder.

    The driver holds one block at a time. Rows of one doc_id and text have the same hits, which are kept once.
    """
    path = f"{c.shared_dir(documents.sparkSession)}/hits"
    for n, rows in enumerate(blocks):
        documents.mapInArrow(_hits(prepare(rows, window), n), HITS).write.mode("append").parquet(path)
    return documents.sparkSession.read.schema(HITS).parquet(path).dropDuplicates(["k", "digest", "block"])


def _keyed(documents: DataFrame) -> DataFrame:
    """(k, digest, doc_id, text): a row is known by its id and the hash of its text."""
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return df.select(c.key().alias("k"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in c.blocks(batches):
        data, off = c.utf8(b.column("text"))
        n = np.diff(c.words(c.LOWER[data], off, c.ALNUM)[2])
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("digest"), b.column("doc_id"), pa.array(n, pa.int64())], ["k", "digest", "doc_id", "n_words"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of all blocks' hits together: words that any of them hits, items of all, the longest match."""
    for b in batches:
        n_words, n_hit, longest, items = b.column("n_words").to_numpy(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
        for k, found in enumerate(b.column("found").to_pylist()):
            items.append({name for x in found or [] for name in x["items"]})
            if found:
                bits = np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint8) for x in found])
                n_hit[k], longest[k] = np.unpackbits(bits, count=int(n_words[k])).sum(), max(x["longest"] for x in found)
        yield _result(b.column("doc_id"), n_words, n_hit, items, longest)


def query_blocks(benchmark: DataFrame, limit: int = QUERY_BLOCK) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most ``limit`` bytes of text and one text more; read a partition at a time, at least one list."""
    rows, size, some = [], 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len((r[1] or "").encode("utf-8", "replace"))
        if size >= limit:
            yield rows
            rows, size, some = [], 0, True
    if rows or not some:
        yield rows


def _first(blocks: Iterator[list[tuple]]) -> tuple[list[tuple], Iterator[list[tuple]] | None]:
    """The first block, and all blocks if there are more than it."""
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else itertools.chain([first, second], blocks)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """One row per row of documents: words, words inside benchmark windows, items met, and the longest verbatim match.

    Null or empty texts have no words; an empty benchmark hits nothing; items without words never hit; benchmark rows
    with a null item_id are no items; the text of an item that occurs in several rows counts once for each text. Rows that
    repeat a doc_id, or have none, are each judged by their own text; very long texts are a shard of their own. Of a
    benchmark of several blocks each block's hits are stored, and no text is shuffled.
    """
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    first, several = _first(query_blocks(benchmark, block))
    if several is None:
        return df.mapInArrow(_whole(prepare(first, window)), RESULT)
    df = _keyed(documents)
    hits = _stored_hits(df, several, window).groupBy("k", "digest").agg(F.collect_list(F.struct("bits", "items", "longest")).alias("found"))  # one for each block
    counted = df.mapInArrow(_count, "k long, digest string, doc_id long, n_words long")
    return counted.join(hits, ["k", "digest"], "left").select("doc_id", "n_words", "found").mapInArrow(_summed, RESULT)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The longest verbatim match of every benchmark suffix of at least ``window`` words in each shard, with all its places."""
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    places = "item_id string, item_word long, n_words long, doc_id long, doc_word long"

    def found(rows: list[tuple]) -> DataFrame:
        names = [str(n) for n, t in rows if n is not None and WORD.search((t or "").encode("utf-8", "replace").lower())]
        q = prepare(rows, window)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in c.blocks(batches):
                ids = b.column("doc_id").to_pylist()
                if len(f := scan_block(*c.utf8(b.column("text")), q)["places"]):
                    text, at, n, docs, places = f
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in text]), pa.array(at), pa.array(n), pa.array([ids[d] for d in docs], pa.int64()), pa.array(places)], ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        return df.mapInArrow(scan, places)

    first, several = _first(query_blocks(benchmark, block))
    if several is None:
        return found(first)
    path = f"{c.shared_dir(documents.sparkSession)}/places"
    for rows in several:
        found(rows).write.mode("append").parquet(path)
    return documents.sparkSession.read.schema(places).parquet(path)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The documents, all columns, without those that share a window with the benchmark; judged where they are read.

    Null, empty and very long texts, repeated rows and null ids as in contamination(): each row by its own text. For a
    benchmark of several blocks the rows that any of them hits are stored by key, and an anti-join removes them.
    """

    def clean(q: Queries):
        @F.pandas_udf("boolean")
        def judged(text: pd.Series) -> pd.Series:
            batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(text, type=pa.string())], ["text"])
            out = []
            for b in c.blocks([batch]):
                f = scan_block(*c.utf8(b.column("text")), q)
                out.append(np.diff(np.concatenate([[0], np.cumsum(f["hit"])])[f["begin"]]) == 0)
            return pd.Series(np.concatenate(out or [np.zeros(0, bool)]))

        return judged(F.col("text").cast("string"))

    first, several = _first(query_blocks(benchmark, block))
    if several is None:
        return documents.where(clean(prepare(first, window)))
    hits = _stored_hits(_keyed(documents), several, window)
    k, digest = c.fresh(documents, "k"), c.fresh(documents, "digest")
    keyed = documents.withColumn(k, c.key()).withColumn(digest, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    bad = hits.select(F.col("k").alias(k), F.col("digest").alias(digest)).distinct()
    return keyed.join(bad, [k, digest], "left_anti").drop(k, digest)
