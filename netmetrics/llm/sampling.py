"""Bounded training samples and the fold that all learned operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c


#: Values of ``by`` whose numbers of rows are broadcast; those of more are joined.
MOST_VALUES = 1000


def held_out(doc_id: str = "doc_id") -> Column:
    """Fixed by the contract: crc32 of doc_id as text, mod 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def bounded(ids: DataFrame, rows: int, by: str) -> DataFrame:
    """About ``rows`` of these rows of each value of ``by``, chosen by 63 bits of a hash of doc_id that no fold or label uses.

    Counts are exact and over all rows; the sample is all rows of a value as long as there are no more than ``rows``.
    """
    draw = F.xxhash64(F.col("doc_id"), F.lit("sample")).bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    size = c.fresh(ids, "size")
    sizes = ids.groupBy(by).agg(F.count("*").alias(size))
    few = sizes.limit(MOST_VALUES + 1).collect()
    if len(few) <= MOST_VALUES:
        sizes = F.broadcast(ids.sparkSession.createDataFrame(few, sizes.schema))  # at most MOST_VALUES rows
    return ids.join(sizes, by).where((F.col(size) <= rows) | (draw < F.lit(float(rows)) / F.col(size))).select(*ids.columns)


def piece(text: str, chars: int) -> Column:
    """The text, or of a longer one ``chars`` characters from a place that a hash of doc_id gives."""
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece")), F.greatest(F.length(text) - F.lit(chars) + 1, F.lit(1)))
    return F.substring(F.col(text), at.cast("int") + 1, F.lit(chars))
