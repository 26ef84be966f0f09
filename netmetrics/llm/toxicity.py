"""Toxicity by compression distance: windows of a text compressed with a dictionary of toxic and one of ordinary text.

Both dictionaries begin with the same trained zstandard content of ordinary text. The toxic one goes on with the words of
the toxic rows, weighted by how many rows have them and by their smoothed log-odds against ordinary rows, the ordinary one
with as many bytes that match nothing, so a clean window costs the same with either and only toxic material makes a
difference. The savings of a text's windows become a score by a logistic curve, calibrated on training rows that made no
dictionary. How many of the weighted words the dictionary holds, up to all of them, is chosen by the curve's likelihood.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c
from netmetrics.llm.sampling import bounded, held_out, piece

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW, STRIDE, LEVEL, ORDINARY_BYTES = 32, 20, 6, 8192
#: Bytes of weighted words in the first toxic dictionary that is tried; each further one has twice as many, the last all.
FIRST_BYTES = 16
#: The classifier is fitted on at most about so many labelled rows of each class, and so many characters of each.
TRAIN_ROWS, TRAIN_CHARS = 2500, 20_000
RESULT = "doc_id long, held_out boolean, score double, predicted int, saved_most double"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float


def normal(text: str | None) -> bytes:
    return b" " + b" ".join(WORD.findall((text or "").encode("utf-8", "replace").lower())) + b" "


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


class Compressors:
    def __init__(self, m: Model) -> None:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.made = []
        for raw in (m.ordinary, m.toxic):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.made.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))

    def saved(self, text: bytes) -> np.ndarray:
        """For the windows of a text: bytes saved by the toxic dictionary."""
        a, b = (x.compress for x in self.made)
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.float64)


def describe(saved: np.ndarray) -> np.ndarray:
    """What the score is made of: the most saved in a window, the mean of the three best, windows with a real saving."""
    top = np.sort(saved)[-3:]
    return np.array([top[-1], top.sum() / 3, np.log1p(np.maximum(saved - 2, 0).sum()), np.log1p(len(saved))])


def _dictionary(samples: list[bytes], size: int, seed: int) -> bytes:
    """Content of a dictionary trained by zstandard; the samples themselves where they are too few to train on."""
    samples = [x for x in samples if len(x) > 8]
    if not samples:
        return b""
    draw = np.random.default_rng(seed).integers(0, len(samples), max(len(samples), 3000))
    try:
        return zstandard.train_dictionary(size, [samples[i] for i in draw]).as_bytes()[-(size - 300) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def weighted_words(texts: tuple[list[bytes], list[bytes]]) -> list[bytes]:
    """Words that favour toxic rows, the weightiest first: rows that have it times its smoothed log-odds."""
    seen = [Counter(), Counter()]
    for y in (0, 1):
        for t in texts[y]:
            seen[y].update(set(t.split()))
    odds = {w: np.log((k + 0.5) / (len(texts[1]) + 1)) - np.log((seen[0][w] + 0.5) / (len(texts[0]) + 1)) for w, k in seen[1].items()}
    return sorted((w for w, x in odds.items() if x > 0), key=lambda w: (-seen[1][w] * odds[w], w))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights and bias of the logistic curve, and the mean log-likelihood of y under it."""
    if not len(x) or not 0 < y.mean() < 1:
        return np.zeros(4), 0.0, 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    weight = np.where(y == 1, 1 / y.mean(), 1 / (1 - y.mean())) ** 0.5  # between balanced and as found
    weight /= weight.mean()
    w, b = np.zeros(4), 0.0
    for _ in range(3000):
        g = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w -= 0.3 * (z.T @ g / len(y) + 1e-3 * w)
        b -= 0.3 * g.mean()
    return w / scale, float(b - (w / scale) @ mean), float(-np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w + b)).mean())


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    """rows: (text, 0 or 1). Two thirds make the dictionaries, one third the curve and the choice of the dictionary."""
    order = np.random.default_rng(seed).permutation(len(rows))
    made, curve = (order[len(rows) // 3 :], order[: len(rows) // 3]) if len(rows) >= 30 else (order, order)
    texts: tuple[list, list] = ([], [])
    for t in sorted({(normal(rows[k][0]), int(rows[k][1])) for k in made}):
        texts[t[1]].append(t[0])
    ordinary = _dictionary([t[i : i + 200] for t in texts[0] for i in range(0, len(t), 200)], ORDINARY_BYTES, seed)
    words = weighted_words(texts)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    y = np.array([int(rows[k][1]) for k in curve], float)
    best, most, size = None, -np.inf, FIRST_BYTES
    while True:
        n = min(len(words), max(1, int(np.searchsorted(ends, size, "right"))))
        toxic = b" " + b" ".join(reversed(words[:n])) + b" "  # the weightiest nearest to the text
        filler = bytes(np.random.default_rng(seed).integers(1, 32, len(toxic), dtype=np.uint8))
        model = Model(ordinary + filler + b"\0" * 8, ordinary + toxic + b"\0" * 8, np.zeros(4), 0.0)
        tool = Compressors(model)
        x = np.array([describe(tool.saved(normal(rows[k][0]))) for k in curve])
        model.weights, model.bias, likely = _curve(x, y)
        if likely > most:
            best, most = model, likely
        if n == len(words):
            return best
        size *= 2


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """The bounded sample of labelled rows outside the held-out fold; a document of several labels has the largest."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = bounded(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), rows, "toxic")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about 2 x rows ids
    found = found.withColumn("text", piece("text", TRAIN_CHARS))
    return [(t, y) for _, t, y in sorted((r[0], r[1] or "", r[2]) for r in found.collect())]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, saved_most for each row of documents; only the text is looked at.

    Null and empty texts have one empty window; very long texts are scored whole. Without labels of both kinds every score
    is 0. Rows that repeat a doc_id are each scored; a null doc_id is held out; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries: 8 KB and the toxic words of a bounded sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tool = Compressors(m)
        for b in c.blocks(batches):
            x = np.array([describe(tool.saved(normal(t))) for t in b.column("text").to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -50, 50))) if m.weights.any() else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 0])], ["doc_id", "held_out", "score", "predicted", "saved_most"])

    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return df.withColumn("held_out", held_out()).mapInArrow(scan, RESULT)


def fitted(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return train(training_rows(documents, labels, rows))
