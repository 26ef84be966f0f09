"""A training corpus from raw documents: quality, repeated lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netmetrics.llm import common, decontamination, jaccard, line_dedup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; very long texts are judged whole. Each row is judged by itself, so repeated
    rows and rows without an id stay or go by their own text. An empty table stays empty; no column changes.
    """
    common.small_batches(spark)
    return quality.keep_quality(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with lines gone that a document of smaller doc_id holds.

    A null text stays null, and a text may become empty; n_chars is counted anew. Rows of one doc_id keep the lines that they
    share with each other; a null doc_id is the smallest. Very long texts are read whole; no row goes, no other column changes.
    """
    common.small_batches(spark)
    return line_dedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Null and empty texts are near nothing and stay. Rows of one doc_id stay or go together; a null doc_id is the smallest and
    stays. Very long texts count by all their shingles; no column changes.
    """
    common.small_batches(spark)
    return jaccard.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text.

    Null and empty texts stay, and so does everything if the benchmark is empty; very long texts are searched whole. Each row,
    repeated or without an id, is judged by its own text; no column changes.
    """
    common.small_batches(spark)
    return decontamination.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences.

    A null or empty text is the end id alone; longer texts than a sequence are cut, none is dropped. Repeated rows, and rows
    without an id, are packed as often as they occur. An empty table gives no pieces. Other columns are not read.
    """
    common.small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: Token ids and the packing plan are not SQL; tests hold run() against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again as the next one's input."""
    folder, docs = common.shared_dir(spark), common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), folder, f"{k}_{name}")
    return docs
