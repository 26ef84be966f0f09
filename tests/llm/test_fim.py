"""Fill-in-middle against a plain version, its lists, and groups of copies beyond what one task takes."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("netmetrics.llm")

from netmetrics.llm import common as c  # noqa: E402
from netmetrics.llm import fim  # noqa: E402

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    u, h = UNIT.findall(text), sha(f"42:{'' if doc_id is None else doc_id}")
    n, (h1, h2, h3, h4) = len(u), (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def documents():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t \n", "one", " one ", "é  日本 x\n", "a <P> b c d", "a<b <S >", "<", "P>x <", "x" * 9000, "w " * 5000, "\U0001f600 \x0b y\x1f z"]
    texts += [" ".join(rng.choice(["river", "élan", "日", "of\n\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(k, t) for k, t in enumerate(texts[20:40], 100)]
    return [*rows, *((k, "the same text of many") for k in range(200, 320)), (5, "one"), (5, texts[30]), (None, texts[30]), (None, texts[31]), (None, texts[31])]


@pytest.mark.parametrize("chunk", [1000, 7])
def test_fim(spark, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rows = documents()
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, fim.fim_report(df).collect()), key=key) == sorted((plainly(*r) for r in rows), key=key)
    assert fim.fim_report(df.limit(0)).count() == 0
    index = fim.text_index(df).collect()
    texts = {t or "" for _, t in rows}
    assert len({bytes(r["key"]) for r in index}) == len(texts) and sum(len(r["ids"]) for r in index) == len(rows)
    assert (len(index) == len(texts)) == (chunk == 1000) and max(len(r["ids"]) for r in index) <= (120 if chunk == 1000 else 25)


def test_lists():
    rng = np.random.default_rng(5)
    for size, top in ((1, 1), (1, 10**6), (300, 300), (500, 10**5), (2000, 9000)):
        ends = np.sort(rng.choice(np.arange(1, top + 1), size, replace=False))
        raw = fim.elias_fano(ends)
        assert [fim.select(raw, size, k) for k in range(size)] == ends.tolist()
        assert len(raw) <= 3 + size * (2 + max(0, np.log2(top / size))) / 8 + size / 8
    data, off = c.utf8(__import__("pyarrow").array([t or "" for _, t in documents()]))
    ends, at = fim.unit_ends(data, off)
    for k, (_, t) in enumerate(documents()):
        assert ends[at[k] : at[k + 1]].tolist() == np.cumsum([len(x) for x in UNIT.findall(t or "")], dtype=int).tolist()
