"""Catalog tables: text facts, versioned snapshots, key/value metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.functions import text as X
from manualdex.operators import postings as P
from manualdex.schema import META

TEXT_FACTS = ("content_chars", "trimmed_chars", "stripped_chars")


def with_text_facts(files: DataFrame) -> DataFrame:
    """Add text lengths next to the text, so that status, sync and repair jobs never
    read the text itself: whole, blank-trimmed and white-space-stripped lengths."""
    content = F.coalesce(F.col("content"), F.lit(""))
    facts = {
        "content_chars": F.char_length(content),
        "trimmed_chars": F.char_length(F.trim(content)),
        "stripped_chars": F.char_length(X.strip(content)),
    }
    missing = {k: v for k, v in facts.items() if k not in files.columns}
    return files.withColumns(missing) if missing else files


def with_search_keys(files: DataFrame) -> DataFrame:
    """Add the keys that searches look documents up by; stored ones are kept where they are there."""
    keys = P.document_keys(P.searchable_text())
    return files.withColumn("keys", F.coalesce("keys", keys) if "keys" in files.columns else keys)


def write_postings(files: DataFrame, path: str) -> None:
    """One row per key and document, in files sorted by key: a look-up reads the row groups of its keys."""
    rows = files.select(F.explode("keys").alias("key"), "id")
    rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").write.mode("overwrite").parquet(path)


def postings_path(root: str, version: int) -> str:
    return f"{root}/postings={version:08d}"


def spread(df: DataFrame) -> DataFrame:
    """Use every core for inputs of fewer splits than cores; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def snapshot_path(root: str, version: int) -> str:
    return f"{root}/version={version:08d}"


def write_rows(files: DataFrame, root: str, version: int) -> str:
    """Write the rows of one full catalog version with their search keys."""
    path = snapshot_path(root, version)
    with_search_keys(with_text_facts(files)).write.mode("overwrite").parquet(path)
    return path


def write_snapshot(files: DataFrame, root: str, version: int) -> str:
    """Write one full catalog version with its search keys and postings; readers of the previous one are
    undisturbed."""
    path = write_rows(files, root, version)
    write_postings(files.sparkSession.read.parquet(path), postings_path(root, version))
    return path


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(snapshot_path(root, version))


def publish(files: DataFrame, root: str, version: int) -> None:
    """Write a version and then, last of all, a pointer to it: readers never see half a catalog."""
    write_snapshot(files, root, version)
    pointer = files.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    pointer.write.mode("append").parquet(f"{root}/current")


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version."""
    return spark.read.schema("version long").parquet(f"{root}/current").agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root, current_version(spark, root))


def write_meta(pairs: DataFrame, path: str) -> None:
    pairs.select(*META.fieldNames()).write.mode("overwrite").parquet(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).parquet(path)


def has_meta(meta: DataFrame, key: str) -> bool:
    return not meta.filter(F.col("key") == key).isEmpty()


def lookup(files: DataFrame, *ids: int) -> DataFrame:
    """Rows by id: a pushed-down filter on the scan."""
    return files.filter(F.col("id").isin(*ids))
