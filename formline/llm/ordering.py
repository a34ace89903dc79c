"""Running totals over a global order, in slices that no hot key can unbalance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.session import stored


def range_slices(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` range-sorted into slices and stored, with the number of each row's slice.

    ``order`` should tell all rows apart, so that a slice can be cut anywhere.  ``rows`` is read twice (once to find
    the cuts), hence should be a stored table.
    """
    return stored(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), name)


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Adds ``before``, the ``amount`` of earlier rows with the same keys, and ``whole``, that of all of them.

    Keys are not null; (keys, order) tells all rows apart.  A key of any size is spread over slices: each task orders
    one slice, and a key's totals by slice are at most as many rows as there are slices.
    """
    keys = list(keys)
    slices = range_slices(rows, [*keys, *order], name)
    totals = slices.groupBy(*keys, "slice").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "slice",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_skipped"),
        F.sum("_total").over(Window.partitionBy(*keys)).alias("whole"),
    )
    inside = Window.partitionBy("slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = slices.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    ranked = ranked.join(offsets, ["slice", *keys]).withColumn("before", F.col("_skipped") + F.col("_inside"))
    return ranked.drop("_skipped", "_inside", "slice")
