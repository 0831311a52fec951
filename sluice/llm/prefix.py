"""Prefix sums within groups, without bringing a group to one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window task of a group is meant to hold.
ROWS = 5000


def prefix_sums(df: DataFrame, group: str, key: str, tie: str, value: str, n_rows: int, rows: int = ROWS) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of ``group`` that come before in (``key``, ``tie``) order.

    ``key`` is a uniform 64-bit hash. It is cut into equal ranges; the sums of
    the ranges are few and get their own prefix sums, and a window runs within
    a (group, range) only, so that a group with a third of all rows is spread like the rest.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / rows)))
    df = df.withColumn("_range", F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long"))
    totals = df.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group), F.col("_range"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).cast("long").alias("_offset")
    )
    within = Window.partitionBy(group, "_range").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, [group, "_range"]).withColumn(
        "before", (F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")
    ).drop("_offset", "_range")
