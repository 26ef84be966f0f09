"""Fill-in-middle from a distinct-text index.

Identical texts are grouped by their content's SHA-256, and a group whose members differ in length or in a second hash is an
error. An index row is a distinct text with its documents; its units' ends are found once, as an Elias-Fano list, and each
document selects its seeded cut from it. A text crosses the shuffle once for each task that holds it, not once for each copy;
one of more copies than ``hot_bound`` is dealt out as several index rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

SEED = 42
#: Fixed by the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_SHARE = 50, 80
#: A group of copies in one task: so many rows, or one of HOT_SHARE of all rows, so that at most HOT_SHARE groups are hot.
CHUNK, HOT_SHARE = 1000, 10_000
INDEX = "struct<n:bigint,ends:binary>"
_POP = np.array([bin(x).count("1") for x in range(256)], np.int64)


def unit_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units in code points from their own text's start, and where each text's units begin (n + 1).

    A unit is a word with the white space before it; white space after the last word is one more.
    """
    _, ends, at = c.words(data, off, c.NOT_SPACE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = len(off) - 1
    last = np.zeros(n, np.int64)
    has = at[1:] > at[:-1]
    last[has] = ends[at[1:][has] - 1]
    tail = np.where(has, last < off[1:], off[1:] > off[:-1])
    starts = at + np.concatenate([[0], np.cumsum(tail)])
    out = np.empty(len(ends) + int(tail.sum()), np.int64)
    own = np.ones(len(out), bool)
    own[starts[1:][tail] - 1] = False
    out[own], out[~own] = ends, off[1:][tail]
    return points[out] - np.repeat(points[off[:-1]], np.diff(starts)), starts


def elias_fano(ends: np.ndarray) -> bytes:
    """A rising list: its low bits side by side, its high bits in unary; some 2 + log2(mean gap) bits an entry."""
    if not len(ends):
        return b""
    n, low = len(ends), max(0, int(ends[-1] // len(ends)).bit_length() - 1)
    bits = (ends[:, None] >> np.arange(low - 1, -1, -1)) & 1
    high = np.zeros(n + int(ends[-1] >> low) + 1, np.uint8)
    high[(ends >> low) + np.arange(n)] = 1
    return bytes([low]) + np.packbits(bits.astype(np.uint8).ravel()).tobytes() + np.packbits(high).tobytes()


def select(raw: bytes, n: int, k: int) -> int:
    """Entry k (from 0) of the n of an Elias-Fano list."""
    low, split = raw[0], 1 + (n * raw[0] + 7) // 8
    high = np.frombuffer(raw, np.uint8, offset=split)
    ones = np.cumsum(_POP[high])
    byte = int(np.searchsorted(ones, k + 1))
    before = int(ones[byte - 1]) if byte else 0
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[k - before])
    value = (place - k) << low
    if low:
        first = k * low
        window = int.from_bytes(raw[1 + first // 8 : 1 + (first + low + 7) // 8], "big")
        width = 8 * ((first + low + 7) // 8 - first // 8)
        value |= (window >> (width - first % 8 - low)) & ((1 << low) - 1)
    return value


def _indexed(text: pa.Array) -> pa.Array:
    counts, lists = [], []
    for b in c.blocks([pa.RecordBatch.from_arrays([text], ["text"])]):
        ends, at = unit_ends(*c.utf8(b.column("text")))
        for k in range(len(at) - 1):
            counts.append(int(at[k + 1] - at[k]))
            lists.append(elias_fano(ends[at[k] : at[k + 1]]))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lists, pa.binary())], ["n", "ends"])


def _ends(raw: pa.Array, n: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """The ends of the first a and of the first b units."""
    rows = zip(raw.to_pylist(), n.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([[select(x, m, k - 1) if k else 0 for k in (i, j)] for x, m, i, j in rows], pa.list_(pa.int64()))


def _groups(docs: DataFrame, *more: str) -> DataFrame:
    """(key, text, copies, ids): one row for each distinct text (and values of ``more``), its content verified by length and a
    second hash, with the doc_ids that hold it.
    """
    t = docs.withColumn("check", F.xxhash64("text", F.octet_length("text")))
    ids = F.collect_list(F.struct("doc_id"))  # nulls stay; at most a few times the rows of CHUNK or HOT_SHARE
    g = t.groupBy("key", *more).agg(F.first("text").alias("text"), F.min("check").alias("lo"), F.max("check").alias("hi"), ids.alias("ids"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("text")).otherwise(F.raise_error(F.lit("two texts of one SHA-256")))
    return g.select("key", same.alias("text"), "ids").withColumn("units", F.arrow_udf(_indexed, INDEX)("text"))


def _own(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key); a null text is empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("key", F.unhex(F.sha2("text", 256)))


def _dealt(docs: DataFrame) -> DataFrame:
    """_groups of documents, a text of many copies once for each so many of them."""
    own = _own(docs)
    counts = c.written(own.groupBy("key").agg(F.count("*").alias("copies")), c.shared_dir(docs.sparkSession), "copies")
    bound = hot_bound(counts.agg(F.sum("copies")).first()[0] or 0)
    # at most HOT_SHARE keys, since each has more than that share of all rows
    hot = F.broadcast(counts.where(F.col("copies") > bound).select("key", F.ceil(F.col("copies") / bound).alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0).cast("long"))
    return _groups(own.join(hot, "key", "left").withColumn("salt", salt).drop("salts"), "salt")


def text_index(docs: DataFrame) -> DataFrame:
    """(key, ids, n, ends): of each distinct text its SHA-256, documents, units, and their ends as an Elias-Fano list.

    A text of more copies than ``hot_bound`` has a row for each share of its documents.
    """
    return _dealt(docs).select("key", F.col("ids.doc_id").alias("ids"), "units.n", "units.ends")


def drawn(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of the hex SHA-256 of seed:doc_id; a null doc_id is the empty string."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    of = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return F.when(form == "plain", output).when(form == "psm", F.concat(*(F.get(part, F.lit(k)) for k in of["psm"]))).otherwise(F.concat(*(F.get(part, F.lit(k)) for k in of["spm"])))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs.

    Nulls and empty texts are plain and empty, with no unit; very long texts are cut like others. A null doc_id draws by the
    empty string. Rows that repeat a doc_id each give a row, with the same draw. Columns besides doc_id and text are not
    read. An empty table gives no rows.
    """
    both = _dealt(docs).select(F.explode("ids.doc_id").alias("doc_id"), "text", "units.n", "units.ends")
    h1, h2, h3, h4 = drawn(F.col("doc_id"), seed)
    text = F.col("text")
    plain = (text == "") | text.rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}") | (h3 % 100 >= rate)
    both = both.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm"))
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = F.when(F.col("form") == "plain", F.lit(0)).otherwise
    both = both.withColumn("at", F.arrow_udf(_ends, "array<bigint>")("ends", "n", cut(F.least(x, y)), cut(F.greatest(x, y))))
    a, b = F.col("at")[0], F.col("at")[1]
    head, middle, tail = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")), F.substring(text, (b + 1).cast("int"), F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)
    own = F.col("form") != "plain"
    output = F.when(~own, text).when(F.col("form") == "psm", psm).otherwise(spm)
    return both.select("doc_id", "n", "form", F.when(own, a).alias("prefix_chars"), F.when(own, b - a).alias("middle_chars"), output.alias("output"))


def hot_bound(rows: int) -> int:
    """Copies of one text that one task takes: CHUNK, or a HOT_SHARE-th of all rows if that is more."""
    return max(CHUNK, -(-rows // HOT_SHARE))


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text rebuilt from it."""
    x = fill_in_middle(docs)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
