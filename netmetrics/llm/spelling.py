"""Spelling variants: words at distance one by a trie self-join with active nodes.

Two words of m and of m or m + 1 letters at distance one agree in their first m // 2 letters or in their last m - m // 2. So
the vocabulary is a trie of its words and a trie of its reversed words, cut in partitions by class m and prefix; a word lies in
at most two partitions of each. In a partition nodes are walked level by level: a node is active for itself at distance 0;
a pair of siblings, or a node and its child, at distance 1, and such pairs follow equal letters only. Pairs of nodes that
reach their ends together are the words at distance one, each found once.

A partition of more than SPLIT words becomes those of its children. What differs at the cut itself is met by what is left of
the word without that letter: groups of at most a letter each of the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Fixed by the contract.
RUN = re.compile("[a-zÀ-ÿ]{5,}")
EVERY, SHORTEST, FEWEST = 97, 5, 3
#: Words of one partition of a trie; larger ones are cut into those of their children.
SPLIT = 1000
#: Rows of partitions that a task walks together, about.
AT_ONCE = 20_000
#: Distinct words that a counting task holds before it hands its counts on.
HELD = 200_000
FOUND = "word string, n_near long, top long, form string"
_LOWER = bytes(c.LOWER)


def _emitted(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts, some words in several rows."""
    total: dict[str, int] = {}
    for b in batches:
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not raw:
                continue
            begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for w, n in Counter(RUN.findall(raw.translate(_LOWER).decode())).items():
                h = zlib.crc32(w.encode(), begun)
                if h % EVERY == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < SHORTEST:
                        continue
                total[w] = total.get(w, 0) + n
            if len(total) > HELD:
                yield _emitted(total)
                total = {}
    yield _emitted(total)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST letters and FEWEST occurrences over all documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def _placed(words: DataFrame) -> DataFrame:
    """(way, m, p, s, n): each word's places in both tries (way 0 and 1): class, the prefix of its partition, what is left."""
    size, ways = F.length("word"), []
    for way, own, at in ((0, F.col("word"), lambda m: F.floor(m / 2)), (1, F.reverse("word"), lambda m: m - F.floor(m / 2))):
        for m in (size, size - 1):
            h = at(m).cast("int")
            ways.append(F.struct(F.lit(way).alias("way"), m.alias("m"), F.substring(own, F.lit(1), h).alias("p"), F.substring(own, h + 1, size).alias("s")))
    return words.select("n", F.explode(F.array(*ways)).alias("t")).select("t.*", "n").where(F.col("m") >= SHORTEST)


def _cut(hot: DataFrame) -> DataFrame:
    """(word, n_near, top, form), a row for each near word, of words of a cut partition that differ in the letter after it."""
    size, long = F.length("s"), F.length("s") > F.col("m") - F.length("p")
    word = F.when(F.col("way") == 0, F.concat("p", "s")).otherwise(F.reverse(F.concat("p", "s")))
    own = hot.where(size > 0).select("way", "m", "p", word.alias("word"), "n", F.substring("s", 1, 1).alias("a"), F.substring("s", F.lit(2), size).alias("x"), "s", long.alias("long"))
    key = ["way", "m", "p", "x"]
    other = own.select(*key, F.col("word").alias("form"), F.col("n").alias("top"), F.col("a").alias("b"), F.col("long").alias("long_"))
    swapped = own.where("not long").join(other.where("not long_"), key).where("a <> b").select("word", "top", "form")
    # the longer word without its letter is the shorter one; if that begins with the same letter they part further down
    short = own.where("not long").select("way", "m", "p", F.col("s").alias("x"), F.col("word").alias("form"), F.col("n").alias("top"))
    grown = own.where("long").join(short, key).where("x = '' or substring(x, 1, 1) <> a")
    # way 1 leaves to way 0 what agrees in the first m // 2 letters
    half = F.floor(F.col("m") / 2).cast("int")
    grown = grown.where((F.col("way") == 0) | (F.substring("word", F.lit(1), half) != F.substring("form", F.lit(1), half)))
    both = grown.select(F.explode(F.array(F.struct("word", "top", "form"), F.struct(F.col("form").alias("word"), F.col("n").alias("top"), F.col("word").alias("form")))).alias("t")).select("t.*")
    return swapped.unionByName(both).select("word", F.lit(1).cast("long").alias("n_near"), "top", "form")


class _Trie:
    """The rows of partitions of one way, class and prefix length, sorted: nodes of each depth are runs of rows."""

    def __init__(self, group: np.ndarray, s: list[str], short: int) -> None:
        self.short = short
        self.n_rows = len(s)
        width = short + 1
        self.letters = np.frombuffer("".join(x.ljust(width, "\0") for x in s).encode("utf-32-le"), np.uint32).reshape(len(s), width).astype(np.int64)
        self.is_long = self.letters[:, short] != 0
        changed = np.ones(len(s), bool)
        changed[1:] = group[1:] != group[:-1]
        self.first = [np.flatnonzero(changed)]  # of each depth: the first row of each node
        self.of = [np.cumsum(changed) - 1]  # of each depth: each row's node
        for d in range(width):
            changed = changed.copy()
            changed[1:] |= self.letters[1:, d] != self.letters[:-1, d]
            self.first.append(np.flatnonzero(changed))
            self.of.append(np.cumsum(changed) - 1)
        longs = np.concatenate([[0], np.cumsum(self.is_long)])
        ends = [np.append(f[1:], len(s)) for f in self.first]
        self.has_long = [longs[e] > longs[f] for f, e in zip(self.first, ends, strict=True)]
        self.has_short = [longs[e] - longs[f] < e - f for f, e in zip(self.first, ends, strict=True)]

    def children(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes of depth d + 1: parent and letter; of those of depth d: where their children begin (one more)."""
        rows = self.first[d + 1]
        parent = self.of[d][rows]
        return parent, self.letters[rows, d], np.searchsorted(parent, np.arange(len(self.first[d]) + 1))

    def followed(self, a: np.ndarray, da: int, b: np.ndarray, db: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of equal letters (not ``bar``) of pairs of active nodes."""
        _, la, at = self.children(da)
        pb, lb, _ = self.children(db)
        count = at[a + 1] - at[a]
        child = np.repeat(at[a] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        letter, of = la[child], np.repeat(b, count)
        keys, want = (pb << 32) | lb, (of << 32) | letter
        found = np.searchsorted(keys, want)
        ok = (found < len(keys)) & (letter != 0)
        ok[ok] = keys[found[ok]] == want[ok]
        if bar is not None:
            ok &= letter != np.repeat(bar, count)
        return child[ok], found[ok]

    def siblings(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, of depth d + 1, of one node that both have a shorter word below: at most a pair of letters each."""
        parent, _, _ = self.children(d)
        use = np.flatnonzero(self.has_short[d + 1])
        p = parent[use]
        after = np.searchsorted(p, p, "right") - np.arange(len(p)) - 1  # later children of the same node
        i = np.repeat(np.arange(len(p)), after)
        j = i + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
        return use[i], use[j]

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (i, j) at distance one, and whether j is the longer."""
        none = np.zeros(0, np.int64)
        sa, sb, ga, gb = none, none, none, none
        for d in range(self.short + 1):
            parent, letter, _ = self.children(d)
            new = np.flatnonzero(self.has_long[d + 1] & self.has_short[d][parent])  # a letter more on the longer side
            na, nb, bar = parent[new], new, letter[new]
            if d == self.short:
                ga, gb = np.concatenate([ga, na]), np.concatenate([gb, nb])
                break
            old = self.followed(ga, d, gb, d + 1)
            fresh = self.followed(na, d, nb, d + 1, bar)
            ga, gb = np.concatenate([old[0], fresh[0]]), np.concatenate([old[1], fresh[1]])
            keep = self.has_short[d + 1][ga] & self.has_long[d + 2][gb]
            ga, gb = ga[keep], gb[keep]
            sa, sb = self.followed(sa, d, sb, d)
            keep = self.has_short[d + 1][sa] & self.has_short[d + 1][sb]
            fresh = self.siblings(d)
            sa, sb = np.concatenate([sa[keep], fresh[0]]), np.concatenate([sb[keep], fresh[1]])
        # a node's first row is its shorter word
        i = np.concatenate([self.first[self.short][sa], self.first[self.short][ga]])
        j = np.concatenate([self.first[self.short][sb], self.first[self.short + 1][gb]])
        return i, j, np.repeat([False, True], [len(sa), len(ga)])


def _joined(t: pa.Table) -> pa.RecordBatch:
    """For each word of whole partitions: its near words, and the best of them."""
    way, m, n = (t[k].to_numpy() for k in ("way", "m", "n"))
    p, s = t["p"].to_pylist(), t["s"].to_pylist()
    depth = np.fromiter(map(len, p), np.int64, len(p))
    new = np.ones(len(p), bool)
    new[1:] = [p[k] != p[k - 1] for k in range(1, len(p))]
    new[1:] |= (way[1:] != way[:-1]) | (m[1:] != m[:-1])
    group = np.cumsum(new)
    kind = np.unique(np.stack([way, m, depth], 1), axis=0, return_inverse=True)[1].ravel()
    words = [x + y if w == 0 else (x + y)[::-1] for w, x, y in zip(way, p, s, strict=True)]
    pairs = []
    for k in range(kind.max() + 1 if len(kind) else 0):
        rows = np.flatnonzero(kind == k)
        trie = _Trie(group[rows], [s[r] for r in rows], int(m[rows[0]] - depth[rows[0]]))
        i, j, grown = trie.near()
        i, j = rows[i], rows[j]
        if way[rows[0]] == 1 and grown.any():
            half = int(m[rows[0]]) // 2
            twice = np.array([g and words[a][:half] == words[b][:half] for a, b, g in zip(i, j, grown, strict=True)], bool)
            i, j = i[~twice], j[~twice]
        pairs += [(i, j), (j, i)]
    i, j = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    at = np.flatnonzero(np.diff(i, prepend=-1))
    count = np.diff(np.append(at, len(i)))
    return pa.RecordBatch.from_arrays([pa.array([words[r] for r in i[at]], pa.string()), pa.array(count, pa.int64()), pa.array(n[j[at]], pa.int64()), pa.array([words[r] for r in j[at]], pa.string())], ["word", "n_near", "top", "form"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (way, m, p, s, n) in; partitions are kept whole over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < AT_ONCE:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last, at = t.slice(t.num_rows - 1).to_pylist()[0], t.num_rows
        while at and all(t[k][at - 1].as_py() == last[k] for k in ("p", "m", "way")):
            at -= 1
        if at:
            yield _joined(t.slice(0, at))
        held = t.slice(at).to_batches()
    if held:
        yield _joined(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, top, form): for words (word, n), each once, with a near one: their number, and the near word of the
    largest n (ties: the smallest) with that n.
    """
    spark = words.sparkSession
    folder, key = c.shared_dir(spark), ["way", "m", "p"]
    rows, whole, found, k = _placed(words), [], [], 0
    while True:
        hot = c.written(rows.groupBy(*key).agg(F.count("*").alias("size")).where((F.col("size") > SPLIT) & (F.length("p") < F.col("m"))).drop("size"), folder, f"hot{k}")
        if hot.isEmpty():
            whole.append(rows)
            break
        whole.append(rows.join(hot, key, "left_anti"))
        cut = c.written(rows.join(hot, key, "left_semi"), folder, f"cut{k}")
        found.append(_cut(cut))
        rows = cut.select("way", "m", F.concat("p", F.substring("s", 1, 1)).alias("p"), F.substring("s", F.lit(2), F.length("s")).alias("s"), "n")
        k += 1
    every = whole[0]
    for x in whole[1:]:
        every = every.unionByName(x)
    dealt = every.select("way", "m", "p", "s", "n").repartition(c.partitions(spark), *key).sortWithinPartitions(*key, "s")
    out = dealt.mapInArrow(_walked, FOUND)
    for x in found:
        out = out.unionByName(x)
    best = F.min(F.struct((-F.col("top")).alias("t"), F.col("form").alias("form")))
    out = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.t")).alias("top"), F.col("b.form").alias("form"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) for words that have a form: the end of their chain of forms, by doubling.

    A form has at least twice the occurrences, so a chain of any table has less than 64 steps: six rounds.
    """
    now, k = forms.select("word", F.col("form").alias("root")), 0
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = c.written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots{k}")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now, k = now.drop("moved"), k + 1


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary.

    Null and empty texts have no words; very long texts and words count whole. Rows that repeat a doc_id are further text of
    it; a null doc_id is the empty string where the draw asks for it. Of near words with the same n the smallest in code
    point order is the form. Other columns are not read; an empty table gives no rows.
    """
    folder = c.shared_dir(docs.sparkSession)
    words = c.written(vocabulary(docs), folder, "words")
    near = c.written(near_words(words), folder, "near")
    x = words.join(near, "word", "left")
    own = F.col("top") >= 2 * F.col("n")
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(own, F.col("form")).alias("form"), F.when(own, F.col("top")).alias("form_n"))
    x = c.written(x, folder, "forms")
    root = roots(x.where("form is not null"), folder)
    return x.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
