"""Spelling variants against all pairs, with partitions of one word and of all."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("netmetrics.llm")

from netmetrics.llm import spelling  # noqa: E402

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plainly(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def documents():
    rng = random.Random(8)
    words = {"".join(rng.choice("abÉé") for _ in range(rng.randint(4, 8))) for _ in range(300)}
    words |= {"aaaaa" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(80)}
    for w in list(words)[:60]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "z" + w[k + 1 :], w + "a", "a" + w}
    words |= {"spelling", "speling", "spellinge", "xspelling", "x" * 400, "x" * 401, "y" + "x" * 399}
    pool = [w for w in sorted(words) for _ in range(rng.choice([1, 3, 5, 9, 20]))]
    rng.shuffle(pool)
    rows = [(k, "  ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pool[k::40]) + "\n1,x") for k in range(40)]
    return [*rows, (1, rows[1][1]), (None, rows[2][1]), (None, None), (7, ""), (8, "·×÷ ×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷"), (9, "the " * 900 + "spelling " * 900)]


@pytest.mark.parametrize("split", [1000, 3, 40])
def test_variants(spark, monkeypatch, split):
    monkeypatch.setattr(spelling, "SPLIT", split)
    rows = documents()
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = plainly(rows)
    got = [tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(w[4] > 3 for w in want) and any(w[1] and w[1] != w[2] for w in want)


@pytest.mark.parametrize("at_once", [1, 30, 20_000])
def test_partitions_over_the_bounds_of_batches(monkeypatch, at_once):
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    words = sorted({"".join(random.Random(k).choice("ab") for _ in range(5 + k % 2)) for k in range(90)})
    rows = sorted((0, 5, w[:2], w[2:], k + 1) for k, w in enumerate(words))
    t = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("way", "m", "p", "s", "n"))})
    got = {}
    for b in spelling._walked(t.to_batches(max_chunksize=7)):
        for r in b.to_pylist():
            got[r["word"]] = got.get(r["word"], 0) + r["n_near"]
    want = {w: sum(one_apart(w, v) and w[:2] == v[:2] and min(len(w), len(v)) == 5 for v in words) for w in words}
    assert got == {w: k for w, k in want.items() if k}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(df).collect() == [] and spelling.spelling_variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
