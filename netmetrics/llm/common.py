"""Shared pieces of the text operators: bounded Arrow blocks, UTF-8 buffers as numpy arrays, words and their hashes.

Rules that hold for all operators here:

* only the columns an operator reads are selected, so extra columns (whatever their names) never clash;
* a null ``doc_id`` is a document of its own id, sorted before every number (``KEY`` replaces it internally);
* a null text is an empty text;
* rows that repeat a ``doc_id`` are rows of one document id: each gives a row of the result.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds; some twenty times as much memory is in use meanwhile.
BLOCK = 4 << 20
#: Stands for a null doc_id where documents are compared or joined.
NULL_KEY = -(2**63)
U64 = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of documents small enough for a Python worker with a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a temporary one only in local mode where none is set.

    It is deleted when the application ends, since results are read from it until then.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/netmetrics"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return folder.toString()


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that was written."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nobody refers to any more, instead of whenever the JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def byte_class(excluded: Iterable[int]) -> np.ndarray:
    """A table over the 256 bytes: True where the byte belongs to a word. Bytes of 0x80 and more always do."""
    out = np.ones(256, bool)
    out[list(excluded)] = False
    return out


#: Fixed by the contract: white space is \x20 and \x09-\x0D.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = byte_class(SPACE)
#: Fixed by the contract: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of all documents, and where each document's words begin (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_rng = np.random.default_rng(20240607)
#: An odd number for each byte value.
BYTE = (_rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
STEP = U64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(29))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; the words must be in order and not overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    where = np.arange(int(length.sum()), dtype=np.int64)
    begin = np.cumsum(length) - length
    inner = where - np.repeat(begin, length)
    if len(where) == len(data):
        raw = data
    else:
        raw = data[inner + np.repeat(starts, length)]
    value = BYTE[raw] * powers(int(length.max()))[inner]
    return mixed(np.add.reduceat(value, begin) + length.astype(U64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each start that has n words."""
    if len(h) < n:
        return np.zeros(0, U64)
    p, out = powers(n), np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        out += h[j : j + len(out)] * p[j]
    return mixed(out)


def hex_sha256(raw: bytes) -> str:
    import hashlib

    return hashlib.sha256(raw).hexdigest()
