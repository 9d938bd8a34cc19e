"""Equi joins against one row per key when one key may hold most of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
HOT_KEYS = 1000
#: Rows from which a key is hot: a group row of fewer isn't worth its copies.
HOT_ROWS = 1024


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    size: str,
    spread_by: str,
) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key.

    ``sizes`` holds the number of rows per key and is read on its own, so that an expensive
    ``groups`` is worked out once. The largest keys of ``HOT_ROWS`` or more, at most ``HOT_KEYS`` by
    construction and so safe to broadcast, have their rows dealt over ``SALTS`` shuffle partitions and
    their group row repeated for each. All other keys are joined unsalted.
    """
    key = F.xxhash64(*keys)
    hot = F.broadcast(
        sizes.select(key.alias("_key"), size)
        .orderBy(F.col(size).desc())
        .limit(HOT_KEYS)
        .filter(F.col(size) >= HOT_ROWS)
        .groupBy("_key")
        .agg(F.lit(True).alias("_hot"))
    )
    salt_of_row = F.when(
        F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    ).otherwise(0)
    salts_of_group = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", key).join(hot, "_key", "left").drop("_key")

    dealt = marked(rows).withColumn("_salt", salt_of_row).drop("_hot")
    repeated = marked(groups).withColumn("_salt", F.explode(salts_of_group)).drop("_hot")
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")
