"""Quality rules from repetition coverage: how much of a text lies inside repeated n-grams and lines.

All documents of a block are measured in one numpy pass: rolling hashes of several n-gram lengths, made unique by document,
are sorted; equal neighbours are repeats, and a running sum over their starts and ends gives the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: n-gram length: largest share (in hundredths) of a text's word characters inside n-grams that occur twice or more.
LIMITS = {5: 50, 8: 35, 12: 30}
#: Largest share (in hundredths) of a text's word characters in lines equal to an earlier line.
LINE_LIMIT = 40
#: Fixed by the contract.
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MIN_WORDS, BASE_N, BASE_LIMIT = 20, 8, 30
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in LIMITS)


def covered(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its document has twice or more."""
    out = np.zeros(len(h), bool)
    g = c.gram_hashes(h, n)
    if not len(g):
        return out
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
    own = g[at] ^ c.mixed(doc[at].astype(c.U64) + c.STEP)
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[at[repeated]] += 1
    np.add.at(edge, at[repeated] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[begin])


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of all documents of a block."""
    starts, ends, begin = c.words(data, off, c.NOT_SPACE)
    n_words, n = np.diff(begin), len(off) - 1
    doc = np.repeat(np.arange(n), n_words)
    h = c.word_hashes(data, starts, ends)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points before a byte
    chars = lead[ends] - lead[starts]
    out = {"n_words": n_words, "word_chars": _sums(chars, begin), "n_symbols": _sums(SYMBOLS[data], off)}
    for k in sorted({BASE_N, *LIMITS}):
        cover = covered(h, doc, k)
        if k == BASE_N:
            out["n_repeat_words"] = _sums(cover, begin)
        if k in LIMITS:
            out[f"dup_chars_{k}"] = _sums(cover * chars, begin)
    dup_lines, dup_chars, raw, before = np.zeros(n, np.int64), np.zeros(n, np.int64), data.tobytes(), np.concatenate([[0], np.cumsum(chars)])
    for d in range(n):
        at, seen = int(off[d]), set()
        text = raw[off[d] : off[d + 1]]
        if b"\n" not in text:
            continue
        for line in text.split(b"\n"):
            if line in seen and line.strip(b" \t\n\v\f\r"):
                dup_lines[d] += 1
                a, b = np.searchsorted(starts, (at, at + len(line)))
                dup_chars[d] += before[b] - before[a]
            seen.add(line)
            at += len(line) + 1
    return out | {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in c.blocks(batches):
        m = measure(*c.utf8(b.column("text")))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_LIMIT * m["n_words"])
        bad = 100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
        for n, limit in LIMITS.items():
            bad |= 100 * m[f"dup_chars_{n}"] > limit * m["word_chars"]
        m |= {"base_failed": failed, "kept": ~failed & ~bad}
        names = [x.split()[0] for x in RESULT.split(", ")][1:]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[x]) for x in names)], ["doc_id", *names])


def quality(documents: DataFrame) -> DataFrame:
    """The measures and verdicts of each row of documents; null and empty texts have no words and fail the base rule.

    kept: not base_failed, and no n-gram length of LIMITS, nor repeated lines, cover more of the text than allowed.
    """
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return df.mapInArrow(_measured, RESULT)


def keep_quality(documents: DataFrame) -> DataFrame:
    """The documents, all columns, that quality() keeps. Each row is judged where it is read: no join."""
    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), pa.Array.from_pandas(text, type=pa.string())], ["doc_id", "text"])
        return pd.Series(np.concatenate([x.column("kept").to_numpy(zero_copy_only=False) for x in _measured([batch])] or [np.zeros(0, bool)]))

    return documents.where(kept(F.col("text").cast("string")))
