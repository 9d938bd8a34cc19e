"""Scan recognition: queue order, merging page texts, finishing, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.operators.numbering import number_rows
from manualdex.operators.skew import join_groups
from manualdex.schema import MIN_TEXT_CHARS, OCR_EXTENSIONS, OCR_STATUSES

# Cost of one page in the queue order, final error text.
PAGE_COST = 500000
TOO_LITTLE_TEXT = "OCR не извлёк достаточно текста"
PAGES_PER_PIECE = 256


def waiting() -> Column:
    return F.col("extension").isin(*OCR_EXTENSIONS) & F.col("extraction_status").isin(*OCR_STATUSES)


def queue(files: DataFrame) -> DataFrame:
    """Files waiting for recognition, cheapest first, with their place in the queue."""
    cost = F.when(
        (F.col("extension") == ".pdf") & (F.col("ocr_total_pages") > 0),
        F.col("ocr_total_pages").cast("long") * PAGE_COST,
    ).otherwise(F.coalesce(F.col("size"), F.lit(0)))
    rows = files.filter(waiting()).select(
        "id", "filename", "filepath", "is_cloud", "ocr_page", "ocr_total_pages", "extension",
        F.coalesce("size", F.lit(0)).alias("size"),
        cost.alias("cost"),
    )
    return number_rows(rows, [F.col("cost"), F.col("id")], "position")


def fresh_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``file_id``, ``page``, ``p`` (total_pages, text): pages of waiting files after the last saved one, each once."""
    resume = files.filter(waiting()).select(
        F.col("id").alias("file_id"), F.coalesce("ocr_page", F.lit(0)).alias("_saved")
    )
    once = pages.groupBy("file_id", "page").agg(
        F.max(F.struct("total_pages", F.coalesce("text", F.lit("")).alias("text"))).alias("p")
    )
    sizes = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"))
    return join_groups(once, resume, sizes, ["file_id"], "pages", "page").filter(F.col("page") > F.col("_saved"))


def merged_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Text to append per file: the pages after the last saved one, in page order.

    Repeated deliveries of a page collapse first. Pages are joined in runs of
    ``PAGES_PER_PIECE`` and the runs then per file, so a very long document is not built
    from its single pages in one task.
    """
    fresh = fresh_pages(files, pages)

    def in_order() -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
        return F.array_join(F.transform(ordered, lambda s: s["text"]), "")

    line = F.when(F.col("p.text") != "", F.concat(F.lit("\n"), "p.text")).otherwise("")
    pieces = (
        fresh.select(
            "file_id",
            F.floor(F.col("page") / PAGES_PER_PIECE).alias("piece"),
            F.col("page").alias("at"),
            line.alias("text"),
            F.col("p.total_pages").alias("total_pages"),
        )
        .groupBy("file_id", "piece")
        .agg(
            in_order().alias("text"),
            F.max(F.struct("at", "total_pages")).alias("last"),
            F.count(F.lit(1)).alias("pages"),
        )
    )
    return (
        pieces.withColumnRenamed("piece", "at")
        .groupBy("file_id")
        .agg(
            in_order().alias("added_text"),
            F.max("last").alias("last"),
            F.sum("pages").alias("added_pages"),
        )
        .select("file_id", "added_text", "added_pages",
                F.col("last.at").alias("last_page"), "last.total_pages")
    )


def _moment(now: float | None) -> Column:
    """The given time, or the current one, in seconds."""
    return (F.unix_micros(F.current_timestamp()) / 1e6) if now is None else F.lit(float(now))


def merge(files: DataFrame, pages: DataFrame, now: float | None = None) -> DataFrame:
    """Waiting files after their new pages were appended at ``now``; others of the queue unchanged."""
    queue_rows = files.filter(waiting()).select(
        "id", "filename", "content", "ocr_page", "ocr_total_pages",
        "extraction_status", "extraction_error", "ocr_updated",
    )
    added = merged_pages(files, pages).withColumnRenamed("file_id", "id")
    has = F.col("last_page").isNotNull()
    return queue_rows.join(added.withColumnRenamed("total_pages", "_total"), "id", "left").select(
        "id",
        "filename",
        F.when(has, F.concat(F.coalesce("content", F.lit("")), "added_text"))
        .otherwise(F.col("content"))
        .alias("content"),
        F.coalesce("last_page", "ocr_page").alias("ocr_page"),
        F.coalesce("_total", "ocr_total_pages").alias("ocr_total_pages"),
        F.when(has, "ocr_processing").otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(~has, F.col("extraction_error")).alias("extraction_error"),
        F.when(has, _moment(now)).otherwise(F.col("ocr_updated")).alias("ocr_updated"),
        F.coalesce("added_pages", F.lit(0)).cast("int").alias("added_pages"),
    )


def finish(merged: DataFrame, now: float | None = None) -> DataFrame:
    """Close the files whose pages are all saved, at ``now``: enough text is ok, else an error."""
    complete = (F.col("ocr_total_pages") > 0) & (F.col("ocr_page") >= F.col("ocr_total_pages"))
    enough = F.char_length(F.trim(F.coalesce("content", F.lit("")))) >= MIN_TEXT_CHARS
    return merged.withColumns(
        {
            "extraction_status": F.when(complete & enough, "ok")
            .when(complete, "error")
            .otherwise(F.col("extraction_status")),
            "extraction_error": F.when(complete & ~enough, TOO_LITTLE_TEXT)
            .when(~complete, F.col("extraction_error")),
            "ocr_updated": F.when(complete, _moment(now)).otherwise(F.col("ocr_updated")),
        }
    )


def after_stop(files: DataFrame) -> DataFrame:
    """Interrupted files go back to waiting with their saved pages kept."""
    return files.withColumn(
        "extraction_status",
        F.when(F.col("extraction_status") == "ocr_processing", "ocr_pending").otherwise(
            F.col("extraction_status")
        ),
    )


def run_counters(finished: DataFrame) -> DataFrame:
    """Files done, files failed, files in the run, and whether any is still unfinished."""
    status = F.col("extraction_status")
    return finished.agg(
        F.count_if(status == "ok").alias("processed"),
        F.count_if(status == "error").alias("errors"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(status.isin(*OCR_STATUSES)) > 0).alias("stopped"),
    )
