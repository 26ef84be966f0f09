"""Ranks and running sums over a whole table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that draw the cuts of text columns, about, whatever the table's size.
SAMPLE = 20_000


def prefix_ranked(df: DataFrame, order: str) -> DataFrame:
    """df with ``rank``: 1, 2, … by a column of distinct values."""
    return exclusive_sums(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "rank").withColumn("rank", F.col("rank") + 1).drop("_one")


def cuts(df: DataFrame, order: str, parts: int) -> list:
    """Values that part df into ``parts`` ranges of about as many rows: quantiles of numbers, of text those of a sample."""
    at = [k / parts for k in range(1, parts)]
    if dict(df.dtypes)[order] != "string":
        return sorted(set(df.agg(F.percentile_approx(order, at, 10000).alias("q")).first()["q"] or []))
    n = df.count()
    drawn = df.select(order).where(F.col(order).isNotNull() & (F.xxhash64(order).bitwiseAND(F.lit(2**62 - 1)) <= int(2**62 * min(1.0, SAMPLE / max(1, n)))))
    got = sorted(r[0] for r in drawn.collect())  # about SAMPLE values
    return sorted({got[int(x * len(got))] for x in at}) if got else []


def exclusive_sums(df: DataFrame, order: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with ``out``: the sum of ``value`` over all rows before, 0 for the first.

    Parts, as many as shuffle partitions, are ranges of ``order``; a row for each part carries the sum of those before it.
    """
    found = cuts(df, order, parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # the number of cuts below a value: the part is computed from the value, so both uses agree
    part = F.coalesce(_below(F.col(order), found), F.lit(0))
    dealt = df.withColumn("_part", part)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    return dealt.join(F.broadcast(before), "_part").withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before")).drop("_part", "_before")  # a row for each part


def _below(x: Column, found: list, base: int = 0) -> Column:
    """How many of the sorted cuts are less than x, by halving: a few comparisons a row for any number of cuts."""
    if not found:
        return F.lit(base)
    middle = len(found) // 2
    return F.when(x > F.lit(found[middle]), _below(x, found[middle + 1 :], base + middle + 1)).otherwise(_below(x, found[:middle], base))


def flushed(x: Column) -> Column:
    """Scores under 2 ** -128, and NaN, are 0."""
    return F.when(F.isnan(x) | (x < 2.0**-128), 0.0).otherwise(x)
