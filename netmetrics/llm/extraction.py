"""Main text of pages by a graphical model on their trees.

Each node of a page's tree, an element or a run of text, is content or not. Nodes have potentials of their own features (tag,
names, length, links, place) and each child one with its parent (by the child's tag). Messages go from the leaves up and
from the root down, a level at a time, for all nodes of all pages of a block together; a run is kept if its content marginal
is over a half. Weights are those that make labelled pages likeliest: what nodes and pairs show less what the marginals expect.

Labelled pages are those of the table that declare their landmarks, a bounded sample, and restyled copies of them whose
layout, names and further parts are drawn (``pages.restyled``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c
from netmetrics.llm import pages as p

#: Rows of the tables of weights that features and tags of children are hashed to.
BUCKETS, TAGS = 1 << 12, 64
#: Learned from at most about so many pages, of at most so many characters each, each restyled so many times.
TRAIN_PAGES, TRAIN_CHARS, STYLES = 120, 40_000, 4
RESULT = "page_id long, url string, text string, n_chars long"
#: Nodes whose messages are passed together, about.
NODES = 50_000


@dataclass
class Model:
    own: np.ndarray  # BUCKETS: log odds of content by feature
    pair: np.ndarray  # TAGS x 2 x 2: by the child's tag, the parent's and the child's state


class Forest:
    """Trees side by side: parents, levels, features (node, bucket) and the hashed tag of each node."""

    def __init__(self, seen: dict | None = None) -> None:
        self.parent, self.depth, self.kind, self.at, self.feature = [], [], [], [], []
        self.seen = {} if seen is None else seen  # buckets of features, kept from forest to forest

    def _bucket(self, key: tuple) -> int:
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 100_000:  # names of pages are not bounded
                self.seen.clear()
            got = self.seen[key] = zlib.crc32(repr(key).encode()) % BUCKETS
        return got

    def __len__(self) -> int:
        return len(self.parent)

    def add(self, t: p.Tree) -> int:
        """Append a tree; the number of its first node."""
        base, n = len(self.parent), len(t.tag)
        chars, linked, runs, links = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if t.text[k] is not None:
                chars[k], linked[k], runs[k], links[k] = len(t.text[k]), t.linked[k], 1, t.linked[k] > 0
            up = t.parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            runs[up] += runs[k]
            links[up] += links[k]
        bucket, before, total = self._bucket, 0, max(1, chars[0])
        for k in range(n):
            tag, up = t.tag[k], t.parent[k]
            density = 4 * linked[k] // max(1, chars[k])
            size = min(11, chars[k].bit_length())
            keys = [("tag", tag), ("size", tag == "#text", size), ("links", density, size // 3), ("runs", min(8, runs[k]), density)]
            if tag == "#text":
                text = t.text[k]
                parent = t.tag[up]
                end = text[-1]
                keys += [("in", parent), ("in", parent, size // 2), ("end", end if end in ".!?:;,…|»" else "-", size // 3), ("place", 8 * before // total), ("about", min(9, runs[up]), size // 3)]
                if "©" in text or "(c)" in text:
                    keys.append(("copyright", size // 4))
                before += len(text)
            else:
                share = 4 * chars[k] // total
                keys += [("share", tag, share), ("part", tag, t.tag[up]), ("place", tag, 4 * before // total)]
                keys += [("name", x) for x in t.names[k]]
            own = {bucket(x) for x in keys}
            self.at += [base + k] * len(own)
            self.feature += own
            self.parent.append(base + up if k else -1)
            self.depth.append(t.depth[k])
            self.kind.append(bucket(("kind", tag)) % TAGS)
        return base

    def levels(self) -> list[np.ndarray]:
        depth = np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1 if len(depth) else 1)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log1p(np.exp(x.min(axis) - top))  # of two states


def marginals(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The content marginal of each node, and those of each node's (parent, own) states, by messages up and down."""
    n, parent, kind = len(f), np.array(f.parent, np.int64), np.array(f.kind, np.int64)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(np.array(f.at, np.int64), m.own[np.array(f.feature, np.int64)], n)
    pair, levels = m.pair[kind], f.levels()
    below, up = own.copy(), np.zeros((n, 2))  # below: a node with its subtree; up: its message to its parent
    for rows in reversed(levels[1:]):
        up[rows] = _log_sum(pair[rows] + below[rows][:, None, :], 2)
        for y in (0, 1):
            below[:, y] += np.bincount(parent[rows], up[rows, y], n) if len(rows) > n // 8 else 0
        if len(rows) <= n // 8:
            np.add.at(below, parent[rows], up[rows])
    down, both = np.zeros((n, 2)), np.zeros((n, 2, 2))  # down: what the rest of the tree says of a node
    for rows in levels[1:]:
        rest = (below[parent[rows]] + down[parent[rows]] - up[rows])[:, :, None] + pair[rows]
        down[rows] = _log_sum(rest, 1)
        joint = rest + below[rows][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both[rows] = joint / joint.sum((1, 2), keepdims=True)
    z = below + down
    return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500))), both


def train(trees: list[p.Tree], steps: int = 200, rate: float = 0.25, decay: float = 1e-4) -> Model:
    """Weights by ascent (Adam) on the likelihood of the labels of all nodes together."""
    m = Model(np.zeros(BUCKETS), np.zeros((TAGS, 2, 2)))
    if not trees:
        return m
    f, label = Forest(), []
    for t in trees:
        f.add(t)
        label += t.label
    label, parent, kind = np.array(label), np.array(f.parent), np.array(f.kind)
    at, feature = np.array(f.at), np.array(f.feature)
    child = np.flatnonzero(parent >= 0)
    gold = np.zeros((len(f), 2, 2))
    gold[child, label[parent[child]], label[child]] = 1
    weights = [m.own, m.pair]
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    for step in range(1, steps + 1):
        one, both = marginals(f, m)
        pairs = np.zeros_like(m.pair)
        np.add.at(pairs, kind[child], (gold - both)[child])
        gain = [np.bincount(feature, (label - one)[at], BUCKETS) / len(trees), pairs / len(trees)]
        for w, g, a, b in zip(weights, gain, first, second, strict=True):
            g = g - decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def labelled(pages: DataFrame, rows: int = TRAIN_PAGES, styles: int = STYLES, seed: int = 11) -> list[p.Tree]:
    """Labelled trees: the sampled pages that declare their landmarks, and restyled copies of them."""
    n = pages.count()
    draw = F.xxhash64(F.col("page_id"), F.lit("sample")).bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    use = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.length("html") <= TRAIN_CHARS)
    got = sorted((r[0] or 0, r[1]) for r in use.where(draw < rows / max(1, n)).limit(4 * rows).collect())  # about ``rows``
    trees = [t for t in (p.parsed(h) for _, h in got) if p.declared(t)]
    parts = [x for x in map(p.blocks_of, trees) if x]
    rng = np.random.default_rng(seed)
    made = [(x, " ".join("".join(rng.choice(list("aeiou bdklmnrst"), 60)).split()).capitalize() + ".") for x in ("h1", "p", "p", "p")]
    parts = parts or [made[: k + 1] for k in range(4)] * 10  # a table without any landmark
    pool = [x for part in parts for _, x in part[:20]]
    pool = [s.strip() for x in pool for s in x.replace("! ", ". ").split(". ") if s.strip()][:20_000]
    most = lambda: int(rng.integers(1, 120 if rng.random() < 0.1 else 25))
    more = [p.parsed(p.restyled(rng, part[: most()], pool)) for part in parts for _ in range(styles)]
    return 2 * trees + more  # pages as they are count twice


def fitted(pages: DataFrame, rows: int = TRAIN_PAGES) -> Model:
    return train(labelled(pages, rows))


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Null and empty pages, and pages without content, have an empty text; very long pages are read whole. Rows that repeat a
    page_id each give a row; a null page_id or url stays null. Columns besides page_id, url and html are not read. An empty
    table gives no rows. White space of any kind, a line break element too, is a space within a block.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 4 * TAGS floats

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def given(rows: list[tuple], f: Forest) -> pa.RecordBatch:
            keep = marginals(f, m)[0] > 0.5
            texts = ["\n".join(x for k, x in leaves if keep[k]) for _, _, leaves in rows]
            size = [len(x) for x in texts]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array(size, pa.int64())], ["page_id", "url", "text", "n_chars"])

        rows, f = [], Forest()
        for b in batches:
            for page_id, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                t = p.parsed(html or "")
                base = f.add(t)
                rows.append((page_id, url, [(base + k, x) for k, x in enumerate(t.text) if x is not None]))
                if len(f) >= NODES:
                    yield given(rows, f)
                    rows, f = [], Forest(f.seen)
        if rows:
            yield given(rows, f)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(scan, RESULT)


def extracted(pages: DataFrame) -> DataFrame:
    return main_text(pages, fitted(pages))
