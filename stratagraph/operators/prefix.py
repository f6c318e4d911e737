"""Distributed prefix sums: no group, however large, is sorted or summed in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclusive_prefix_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, bucket: Column, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come before this one.

    Rows are ordered by (``bucket``, ``order``); ``order`` must be unique in a group for a total order.
    A window runs only inside (group, bucket); the bucket totals, at most one row for each bucket of a
    group, carry the offsets. ``total`` optionally adds the group's whole sum. Null values count as 0.
    """
    b, s = "__bucket", "__sum"
    rows = df.withColumn(b, bucket)
    value_of = F.coalesce(F.col(value), F.lit(0))
    sums = rows.groupBy(*group, b).agg(F.sum(value_of).alias(s))
    before = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(g).alias(f"__g_{g}") for g in group],
        F.col(b).alias("__g_bucket"),
        F.coalesce(F.sum(s).over(before), F.lit(0)).alias("__carry"),
        *([F.sum(s).over(W.partitionBy(*group)).alias(total)] if total else []),
    )
    same = F.col(b) == F.col("__g_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inside = W.partitionBy(*group, b).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("__inside", F.coalesce(F.sum(value_of).over(inside), F.lit(0)))
        .join(carried, same)
        .withColumn(out, F.col("__inside") + F.col("__carry"))
        .drop(b, "__inside", "__carry", "__g_bucket", *[f"__g_{g}" for g in group])
    )
