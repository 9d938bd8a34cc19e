"""Exact duplicates: same name, same bytes, at least two local copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manualdex.functions import text as X
from manualdex.operators.skew import join_groups
from manualdex.session import cut_lineage


def keyed(files: DataFrame) -> DataFrame:
    """Local, present files that share their name, with their name key and content hash.

    Names are counted on the narrow columns first, and only texts of files whose name occurs twice are
    hashed. The hash is taken where the text is read, so only 64 hexadecimal digits per file,
    never the text, are shuffled as long as the repeated names fit a broadcast.
    """
    named = files.withColumn("name_key", X.strip(F.lower(F.coalesce(F.col("filename"), F.lit(""))))).filter(
        F.col("name_key") != ""
    )
    repeated = cut_lineage(
        named.groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name_key")
    )
    return (
        named.filter((F.coalesce(F.col("is_cloud"), F.lit(0)) == 0) & F.col("content").isNotNull())
        .join(repeated, "name_key", "left_semi")
        .select(
            "id", "filename", "filepath", "name_key",
            F.sha2(F.col("content").cast("binary"), 256).alias("hash"),
        )
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per duplicate group of keyed rows, counted map-side first."""
    return (
        rows.groupBy("name_key", "hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("filename", "id")).getField("id").alias("first_id"),
        )
        .filter(F.col("copies") >= 2)
    )


def members(files: DataFrame) -> DataFrame:
    """Every file of every duplicate group; the first by name is marked.

    The narrow keyed rows are written out first, so each text is read and hashed once.
    """
    rows = cut_lineage(keyed(files))
    found = groups(rows)
    joined = join_groups(rows, found, found, ["name_key", "hash"], "copies", "id")
    return joined.withColumn("is_first", F.col("id") == F.col("first_id"))


def listing(files: DataFrame) -> DataFrame:
    """Display rows: the first member named, the others indented below it."""
    return members(files).select(
        "hash",
        "id",
        F.when(F.col("is_first"), F.concat(F.lit("КЛОН "), "filename"))
        .otherwise(F.concat(F.lit("  → "), "filename"))
        .alias("title"),
        F.lit("Клон").alias("kind"),
        F.lit("100%").alias("similarity"),
        F.lit("Идентичное содержимое").alias("reason"),
        "filepath",
    )


def summary(files: DataFrame) -> DataFrame:
    return groups(keyed(files)).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("files"),
    )
