"""Streaming forms of catalog upkeep: listings, recognised pages, status counts.

Every job is restartable: progress lies in the query's checkpoint, and what a micro-batch
writes is overwritten when the batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manualdex.operators import ocr, sync
from manualdex.operators.numbering import number_rows
from manualdex.session import cut_lineage, run_folder

CHANGES_PARTITION = "batch"


def _latest(changes: DataFrame) -> DataFrame:
    """Last written state per path, merged map-side before the shuffle."""
    columns = [c for c in changes.columns if c not in ("filepath", CHANGES_PARTITION)]
    newest = F.max_by(F.struct(*columns), CHANGES_PARTITION).alias("s")
    return changes.groupBy("filepath").agg(newest).select("filepath", "s.*")


def stream_sync(
    listing: DataFrame,
    catalog: DataFrame,
    root: str,
    work: str | None = None,
    empty_deletes: bool = False,
) -> DataFrame:
    """Apply a stream of listing rows to a catalog and return the new state.

    A micro-batch cuts the catalog to its own paths, which are written first so that their small
    table is broadcast, and appends only its own rows
    to a change table; the catalog itself is not rewritten. When the listing is complete,
    paths below the root that no batch has seen are dropped and new rows get their ids, so
    the result does not depend on how the listing was cut into batches.

    A listing without any row is taken for a store that could not be read and drops nothing,
    unless ``empty_deletes`` says that the root may really be empty.
    """
    spark = catalog.sparkSession
    work = work or run_folder(spark, "sync")
    changes = f"{work}/changes"

    def changed(rows: DataFrame) -> DataFrame:
        return sync.listed_state(sync.classify(catalog, rows, root, listed_only=True))

    def merge(batch: DataFrame, batch_id: int) -> None:
        # The last row wins where a batch lists a path twice.
        rows = batch.groupBy("filepath").agg(
            F.max(F.struct("modified", "size", "filename", "extension", "is_cloud")).alias("n")
        ).select("filepath", "n.*")
        state = changed(cut_lineage(rows))
        state.write.mode("overwrite").parquet(f"{changes}/{CHANGES_PARTITION}={batch_id}")

    # An empty part first: the change table is there, with its columns, when no batch comes.
    none = spark.createDataFrame([], listing.schema)
    changed(none).write.mode("overwrite").parquet(f"{changes}/{CHANGES_PARTITION}=-1")

    (
        listing.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    seen = _latest(spark.read.parquet(changes))
    return finish_sync(catalog, seen, root, drop=empty_deletes or not seen.isEmpty())


def finish_sync(catalog: DataFrame, seen: DataFrame, root: str, drop: bool = True) -> DataFrame:
    """The whole state from the rows that were seen; with ``drop`` others below the root go."""
    outside = (
        sync.narrow_state(catalog)
        .filter(~sync.under(root, F.col("filepath")) if drop else F.lit(True))
        .join(seen.select("filepath"), "filepath", "left_anti")
        .withColumns({"sync_action": F.lit("kept"), "should_extract": F.lit(False), "dirty": F.lit(False)})
    )
    known = seen.filter(F.col("sync_action") != "new")
    added = number_rows(
        seen.filter(F.col("sync_action") == "new").drop("id"),
        [F.col("filepath")],
        "id",
        sync.max_id(catalog),
    ).withColumn("id", F.col("id").cast("long"))
    return (
        known.select(*sync.APPLIED)
        .unionByName(added.select(*sync.APPLIED))
        .unionByName(outside.select(*sync.APPLIED))
    )


def stream_ocr_pages(
    pages: DataFrame, catalog: DataFrame, work: str | None = None, now: float | None = None
) -> DataFrame:
    """Land recognised pages as they arrive, then merge them into their documents.

    The file sink commits each page batch exactly once; pages a file already has and
    repeated deliveries are ignored by the merge.
    """
    spark = catalog.sparkSession
    work = work or run_folder(spark, "pages")
    (
        pages.writeStream.format("parquet")
        .option("path", f"{work}/pages")
        .option("checkpointLocation", f"{work}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    landed = spark.read.schema(pages.schema).parquet(f"{work}/pages")
    return ocr.finish(ocr.merge(catalog, landed, now), now)


def stream_status_counts(files: DataFrame, work: str | None = None) -> DataFrame:
    """Running number of files per status. Each batch writes the counts so far as a table of its own; the
    last one is returned."""
    spark = files.sparkSession
    work = work or run_folder(spark, "status")
    status = F.coalesce(F.nullif("extraction_status", F.lit("")), F.lit("pending"))
    counts = files.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("files"))
    schema = counts.schema

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{work}/counts/{CHANGES_PARTITION}={batch_id}")

    store(spark.createDataFrame([], schema), -1)
    (
        counts.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{work}/progress")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    stored = spark.read.parquet(f"{work}/counts")
    last = stored.agg(F.max(CHANGES_PARTITION).alias("last"))
    return stored.join(F.broadcast(last), F.col(CHANGES_PARTITION) == F.col("last")).select(*schema.fieldNames())
