"""Gapless numbers in an order, over all rows or within groups, that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import col
from sondage.session import cut_lineage, shuffle_partitions

# monotonically_increasing_id keeps the partition above this bit and the row within it below.
_ROW_BITS = 33


def fixed(df: DataFrame) -> DataFrame:
    """The rows in reliable storage, each with a number ``tie`` of its own, so that equal rows can be told apart and split."""
    return cut_lineage(df.withColumn("tie", F.monotonically_increasing_id()))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos`` (from 0 in the order given, within equal values of ``group``) and ``n`` (rows of the group).

    ``df`` should come from ``fixed``, with ``tie`` last in ``order``: then a range never holds more than its share,
    whatever repeats. Rows are dealt into sorted ranges once and written; the numbers of earlier ranges come from
    their counts, one row for each range and group. Nulls sort first.
    """
    keys = [col(c) for c in [*group, *order]]
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ranges = cut_lineage(ranges.withColumn("__id", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("__part", F.shiftright("__id", _ROW_BITS)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    names = [f"__g{k}" for k in range(len(group))]
    counts = ranges.groupBy(F.col("__part").alias("__p"), *[col(c).alias(n) for c, n in zip(group, names)]).agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", *names, (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    match = F.col("__part") == F.col("__p")
    for c, n in zip(group, names):
        match = match & col(c).eqNullSafe(F.col(n))
    return ranges.join(starts, match).select(*[col(c) for c in df.columns], (F.col("__at") + F.col("__shift")).alias("pos"), "n")
