"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams (lower-cased ASCII), hashed to BUCKETS rows of an embedding table; the text is the
mean of their embeddings and a linear layer gives the logits. Since both are linear, a trained model is one table of
BUCKETS x languages, and a prediction is a mean of its rows. A temperature and a rejection threshold are calibrated on
a part of the training rows that SGD did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c
from netmetrics.llm.sampling import bounded, held_out, piece

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: The classifier is fitted on at most about so many labelled rows of each language, and so many characters of each.
TRAIN_ROWS, TRAIN_CHARS = 1000, 20_000
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float


def features(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (fewer than len(data) - n + 1: none)."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    x = c.LOWER[data].astype(np.uint32)
    h = np.full(len(x) - n + 1, n, np.uint32)
    for j in range(n):
        h = (h ^ x[j : len(x) - n + 1 + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    idx, count = np.unique(np.concatenate([features(data, n) for n in GRAMS]), return_counts=True)
    return idx, (count / max(1, count.sum())).astype(np.float32)


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 1.0, seed: int = 7) -> Model:
    """rows: (text, language). A fifth of them, at least one, calibrates the temperature and the threshold."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    place = {x: k for k, x in enumerate(languages)}
    order = rng.permutation(len(rows))
    fit, hold = (order[len(rows) // 5 :], order[: len(rows) // 5]) if len(rows) >= 10 else (order, order)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def spans(text: str) -> Iterator[bytes]:
        raw = text.encode("utf-8", "replace")
        yield raw
        n = int(np.exp(rng.uniform(np.log(12), np.log(800))))  # short pieces too, so that short texts are known
        if len(raw) > n:
            at = int(rng.integers(0, len(raw) - n))
            yield raw[at : at + n]

    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            y, lr = place[rows[k][1]], rate * (1 - step / steps)
            step += 1
            for raw in spans(rows[k][0]):
                idx, w = _bag(raw)
                if not len(idx):
                    continue
                hidden = w @ embed[idx]
                z = hidden @ out + bias
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y] -= 1
                back = out @ g
                out -= lr * np.outer(hidden, g)
                bias -= 0.1 * lr * g
                embed[idx] -= lr * np.outer(w * len(w) ** 0.5, back)
    table = embed @ out
    logits = np.array([(w @ table[idx] + bias) if len(idx) else bias for idx, w in (_bag(next(spans(rows[k][0]))) for k in hold)])
    gold = np.array([place[rows[k][1]] for k in hold])

    def probability(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) * t)
        return e / e.sum(1, keepdims=True)

    grid = np.exp(np.linspace(np.log(0.05), 0, 31))  # only ever softer than trained
    best = float(min(grid, key=lambda t: -np.log(probability(t)[np.arange(len(gold)), gold] + 1e-9).mean()))
    top = probability(best).max(1)
    right = top[probability(best).argmax(1) == gold]
    return Model(languages, table.astype(np.float32), bias, best, float(min(0.9, np.quantile(right, 0.01))) if len(right) else 0.0)


def predict(data: np.ndarray, off: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The most likely language (its number) and its probability for each text."""
    n_docs = len(off) - 1
    total, count = np.zeros((n_docs, len(m.languages))), np.zeros(n_docs)
    for n in GRAMS:
        idx = features(data, n)
        inside = np.clip(off, 0, len(idx))
        ends = np.maximum(np.clip(off[1:] - n + 1, 0, len(idx)), inside[:-1])
        use = np.flatnonzero(ends > inside[:-1])
        if not len(use):
            continue
        pairs = np.stack([inside[:-1][use], ends[use]], 1).ravel()
        count[use] += ends[use] - inside[:-1][use]
        for k in range(len(m.languages)):
            v = np.concatenate([m.table[:, k][idx], [0]])
            total[use, k] += np.add.reduceat(v, pairs, dtype=np.float64)[::2]
    z = (total / np.maximum(count, 1)[:, None] + m.bias) * m.temperature
    e = np.exp(z - z.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    return e.argmax(1), e.max(1)


def has_letter(text: str | None) -> bool:
    return text is not None and next((True for ch in text if ch.isalpha()), False)


def training_rows(documents: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """The bounded sample: rows with a language that are not held out and have a letter; of long texts a piece."""
    use = documents.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    use = bounded(use, rows, "lang").withColumn("text", piece("text", TRAIN_CHARS))
    return [(t, lang) for _, t, lang in sorted(map(tuple, use.collect())) if has_letter(t)]


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of documents; only the text is looked at.

    A null text, one without a letter, or a model without languages: lang_pred und, score 0. rejected: the score is under
    the calibrated threshold, or the text has no letter. Very long texts are looked at whole. Rows that repeat a doc_id are
    each predicted; a null doc_id is held out; an empty table gives no rows.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in c.blocks(batches, limit=1 << 20):
            known = np.array([has_letter(t) for t in b.column("text").to_pylist()]) & bool(m.languages)
            best, score = predict(*c.utf8(b.column("text")), m) if m.languages else (np.zeros(b.num_rows, int), np.zeros(b.num_rows))
            score = np.where(known, score, 0.0)
            names = [m.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < m.threshold))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return df.withColumn("held_out", held_out()).mapInArrow(scan, RESULT)


def fitted(documents: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    got = training_rows(documents, rows)
    return train(got) if got else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
