"""Ordered scans of groups of any size: long groups are cut into segments of their order, and what a row needs of earlier
segments is carried over from a summary of each.

A group of up to ``SEGMENT_ROWS`` rows is scanned by a window. The rows of longer groups are dealt to ranges of (group,
order), so that one group is spread over as many tasks as it needs; summaries have a row for each range.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.scratch import written

#: Rows of a group that one task scans.
SEGMENT_ROWS = 1 << 20
#: Long groups whose keys are broadcast; more are joined.
MANY = 1 << 20

SEGMENT = "_seg"


def segmented(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with _seg: null for groups that one task scans, else the number of the row's range, ascending in ``order``.

    Once cut, a table stays as it is: functions of this package that scan by the same key share the segments.
    """
    if SEGMENT in df.columns:
        return df
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SEGMENT_ROWS)
    long = written(sizes.filter(F.col(key).isNotNull()), "long")
    n, rows = long.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n:
        return df.withColumn(SEGMENT, F.lit(None).cast("int"))
    keys = F.broadcast(long.select(key)) if n <= MANY else long.select(key)
    ranges = df.join(keys, key, "left_semi").repartitionByRange(2 * ceil(rows / SEGMENT_ROWS), F.col(key), *order)
    cut = written(ranges.withColumn(SEGMENT, F.spark_partition_id()), "segments")
    return df.join(keys, key, "left_anti").withColumn(SEGMENT, F.lit(None).cast("int")).unionByName(cut)


def inside(keys: list[str], order: list[Column]):
    """The window of a row's group inside its segment."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def carried(df: DataFrame, keys: list[str], **summary: Column) -> DataFrame:
    """(keys, _seg, summary): aggregates of each segment's rows of the long groups."""
    return df.filter(F.col(SEGMENT).isNotNull()).groupBy(*keys, SEGMENT).agg(*[v.alias(k) for k, v in summary.items()])


def earlier(keys: list[str]):
    """The window of all earlier segments of a group, over a summary."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the carry of its group and segment; null where there is none."""
    return df.join(carry, [*keys, SEGMENT], "left")


def finish(df: DataFrame, before: DataFrame, *added: str) -> DataFrame:
    """``before``'s columns and those ``added``, in place of any of that name; segments are kept only if ``before`` had them."""
    return df.select(*[c for c in before.columns if c not in added], *added)
