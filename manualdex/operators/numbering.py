"""Consecutive numbers in a global order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manualdex.session import cut_lineage


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Add ``name`` = ``start`` + 1, 2, … following ``order`` (which must be total).

    Rows are cut into value ranges, each range numbers its own rows, and the sizes of
    the earlier ranges (one row per range, so bounded by the partition count) are added.
    The ranges are written out because both uses must see the same cut even when an
    executor is lost.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.lit(start) + F.col("_before") + F.col("_rn"))
        .drop("_range", "_rn", "_before")
    )
