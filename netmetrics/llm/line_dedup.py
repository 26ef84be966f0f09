"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (128-bit line hash, first document), bucketed and sorted by the hash, so a batch is merge-anti-joined
with it without moving the run. Each batch of documents loses the lines that the runs hold, adds its own as a run of level
0, and every ``fan_in`` runs of a level are merged into one of the next level. A line that many documents hold leaves each
task once: the copies that a task can see already lost to a smaller doc_id there and only carry the verdict.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Fixed by the contract: stripped from both ends of a line.
STRIP = " \t\n\v\f\r"
MIN_LENGTH = 10
#: Line keys that a task holds before it sends them on.
HELD = 400_000


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None if the key has fewer than MIN_LENGTH code points."""
    k = line.strip(b" \t\n\v\f\r").lower()  # bytes.lower: A-Z only
    if len(k) < MIN_LENGTH or len(k) < 4 * MIN_LENGTH and len(k.decode("utf-8", "replace")) < MIN_LENGTH:
        return None
    return xxhash.xxh3_128_digest(k)


def _digests(ids: list[int], hashes: list[bytes], lost: bool) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(len(ids), lost))], ["k", "h1", "h2", "lost"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and distinct key; lost where a smaller document of the same task holds the key."""
    first: dict[bytes, int] = {}
    for b in c.blocks(batches):
        ids, hashes = [], []
        for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
            for d in {line_key(x) for x in (text or "").encode("utf-8", "replace").split(b"\n")} - {None}:
                if (other := first.setdefault(d, k)) != k:
                    if k < other:
                        first[d] = k
                    ids.append(max(k, other))
                    hashes.append(d)
        if ids:
            yield _digests(ids, hashes, True)
        if len(first) > HELD:
            yield _digests(list(first.values()), list(first), False)
            first.clear()
    if first:
        yield _digests(list(first.values()), list(first), False)


def line_hashes(documents: DataFrame) -> DataFrame:
    """(k, h1, h2, lost): the lines of at least MIN_LENGTH code points of each document, by the hash of their key."""
    df = documents.select(c.key().alias("k"), documents["text"].cast("string").alias("text"))
    return df.mapInArrow(_lines, "k long, h1 long, h2 long, lost boolean")


class LineRuns:
    """The store: ``levels[n]`` are the names of the runs of level n."""

    def __init__(self, spark, fan_in: int = 3) -> None:
        self.spark, self.fan_in, self.levels, self.folder = spark, fan_in, [[]], c.shared_dir(spark)
        self.name, self.made, self.buckets = f"line_runs_{uuid.uuid4().hex}", 0, c.partitions(spark)

    def _write(self, run: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        run.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of (k, h1, h2); returns its (k, h1, h2) that an earlier batch or a smaller k of this one holds.

        The result reads the store's runs: it must be written before the store is closed.
        """
        new = lines.groupBy("h1", "h2").agg(F.min("k").alias("first"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        name = self._write(new)
        own = self.spark.table(name).hint("merge")
        self.levels[0].append(name)
        self._compact()
        return lines.join(own, ["h1", "h2"], "left").where(F.col("first").isNull() | (F.col("first") != F.col("k"))).select("k", "h1", "h2")

    def _compact(self) -> None:
        for n, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                merged = self.spark.table(level[0])
                for x in level[1:]:
                    merged = merged.unionByName(self.spark.table(x))
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self._write(merged))
                self.levels[n] = []

    def close(self) -> None:
        for k in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")
        c.drop_folder(self.spark, self.folder)


def dropped_lines(documents: DataFrame, batches: int = 4) -> DataFrame:
    """(k, drop): for each document that loses lines the digests of their keys. Batches go by rising doc_id."""
    spark = documents.sparkSession
    folder = c.shared_dir(spark)
    cuts = documents.agg(F.percentile_approx(c.key(), [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    batch = sum((F.when(F.col("k") > int(q), 1).otherwise(0) for q in sorted(set(cuts))), F.lit(0))
    line_hashes(documents).withColumn("batch", batch).write.partitionBy("batch", "lost").parquet(f"{folder}/lines")
    lines = spark.read.schema("k long, h1 long, h2 long, batch int, lost boolean").parquet(f"{folder}/lines")
    store = LineRuns(spark)
    try:
        for b in range(len(set(cuts)) + 1):
            found = store.ingest(lines.where((F.col("batch") == b) & ~F.col("lost")).select("k", "h1", "h2"))
            found.write.parquet(f"{folder}/drop/{b}")
    finally:
        store.close()
    out = lines.where("lost").select("k", "h1", "h2").unionByName(spark.read.schema("k long, h1 long, h2 long").parquet(f"{folder}/drop/*"))
    return out.groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _kept(text: str | None, drop) -> tuple[list[bytes], int]:
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    if drop is None or not len(drop):
        return lines, len(lines)
    gone = {np.array([d["h1"], d["h2"]], np.int64).tobytes() for d in drop}
    return [x for x in lines if line_key(x) not in gone], len(lines)


def _marked(documents: DataFrame, batches: int) -> tuple[DataFrame, str]:
    """The documents with a column of the digests that go, and that column's name, which no column of theirs has."""
    k, drop = c.fresh(documents, "k"), c.fresh(documents, "drop")
    drops = dropped_lines(documents, batches).withColumnsRenamed({"k": k, "drop": drop})
    return documents.withColumn(k, c.key()).join(drops, k, "left"), drop


def line_dedup_report(documents: DataFrame, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of documents.

    Null and empty texts are one empty line. Keys under ten code points never go. A key that only one doc_id holds stays,
    however often. Rows that repeat a doc_id lose the same keys. A null doc_id comes before every number.
    """

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def report(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        rows = [(n, n - len(kept), c.hex_sha256(b"\n".join(kept))) for kept, n in map(_kept, text, drop)]
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"])

    df, drop = _marked(documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")), batches)
    return df.select("doc_id", report("text", drop).alias("r")).select("doc_id", "r.*")


def line_dedup(documents: DataFrame, batches: int = 4) -> DataFrame:
    """The documents, all columns, with repeated lines gone from text (and n_chars, if there, counted anew).

    All else as in line_dedup_report; no column of theirs is changed or lost, whatever its name. A null text stays null.
    """

    @F.pandas_udf("string")
    def rest(text: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([t if d is None or not len(d) else b"\n".join(_kept(t, d)[0]).decode("utf-8", "replace") for t, d in zip(text, drop, strict=True)], dtype=object)

    df, drop = _marked(documents, batches)
    df = df.withColumn("text", rest(F.col("text").cast("string"), drop))
    if "n_chars" in documents.columns:
        df = df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    return df.select(*documents.columns)
