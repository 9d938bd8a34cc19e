"""Top-k rows, whole or per key, without gathering k rows of every task in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 64


def top_k(
    df: DataFrame,
    order: Sequence[Column],
    k: int,
    by: Sequence[str] = (),
    rank: str = "rank",
    lanes: int = LANES,
) -> DataFrame:
    """Rows with the k first ranks per ``by`` key, ranked from 1.

    Every task keeps its own k best rows per key (window group limit, for k up to the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold``), the lanes then
    share the merging, and only ``lanes * k`` rows per key meet in the last step. A key
    that holds most rows is therefore spread over all tasks until it is small.
    """
    lane = Window.partitionBy(*by, "_lane").orderBy(*order)
    kept = (
        df.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        .withColumn("_rn", F.row_number().over(lane))
        .filter(F.col("_rn") <= k)
        .drop("_rn", "_lane")
    )
    final = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
