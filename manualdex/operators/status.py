"""Catalog status: filters, listings, counts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.operators.numbering import number_rows
from manualdex.operators.topk import top_k
from manualdex.schema import (
    OCR_EXTENSIONS,
    OCR_STATUSES,
    PENDING_STATUSES,
)
from manualdex.sources.catalog import with_text_facts

# Display names of statuses and storage places.
STATUS_LABELS = {
    "ok": "OK",
    "ocr_pending": "OCR ожидает",
    "ocr_processing": "OCR выполняется",
    "error": "Ошибка",
    "pending": "Ожидает",
    "processing": "Обрабатывается",
    "unsupported": "Неподдерживаемый",
}
CLOUD_LABEL = "☁ Облако"
LOCAL_LABEL = "💾 Локальный"
UNKNOWN_PAGES_LAST = 2147483647


def status_filter(name: str) -> Column:
    status = F.col("extraction_status")
    filters = {
        "ok": status == "ok",
        "ocr": status.isin(*OCR_STATUSES),
        "error": status == "error",
        "pending": status.isNull() | status.isin(*PENDING_STATUSES),
        "unsupported": status == "unsupported",
    }
    return filters.get(name, F.lit(True))


def listing_order(name: str) -> list[Column]:
    if name == "ocr":
        known = F.when(F.col("ocr_total_pages") > 0, F.col("ocr_total_pages"))
        return [F.coalesce(known, F.lit(UNKNOWN_PAGES_LAST)), F.col("id")]
    if name == "error":
        return [F.col("extension"), F.col("filename"), F.col("id")]
    return [F.col("id")]


def listing(files: DataFrame, name: str = "all", limit: int | None = None) -> DataFrame:
    """Status rows in display order; reads the stored text length, not the text.

    Without ``limit`` every row is listed, numbered by value ranges; a limit is a top-k.
    """
    rows = (
        with_text_facts(files)
        .filter(status_filter(name))
        .select(
            "id",
            "filename",
            "extension",
            F.coalesce("extraction_status", F.lit("pending")).alias("status"),
            F.coalesce("extraction_error", F.lit("")).alias("error"),
            "filepath",
            F.coalesce("is_cloud", F.lit(0)).alias("is_cloud"),
            F.coalesce("ocr_page", F.lit(0)).alias("ocr_page"),
            F.coalesce("ocr_total_pages", F.lit(0)).alias("ocr_total_pages"),
            F.col("content_chars").alias("text_chars"),
        )
    )
    if limit is None:
        order = listing_order(name)
        return number_rows(rows, order, "position").withColumn("position", F.col("position").cast("int"))
    return top_k(rows, listing_order(name), limit, rank="position")


def counts(files: DataFrame) -> DataFrame:
    """Rows per status; missing and empty statuses count as pending."""
    status = F.coalesce(F.nullif("extraction_status", F.lit("")), F.lit("pending"))
    return files.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("files"))


def summary(files: DataFrame) -> DataFrame:
    names = ("ok", "ocr", "error", "pending", "unsupported")
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status_filter(n)).alias(n) for n in names],
    )


def ocr_pending_count(files: DataFrame) -> DataFrame:
    waiting = F.col("extension").isin(*OCR_EXTENSIONS) & F.col("extraction_status").isin(
        *OCR_STATUSES
    )
    return files.filter(waiting).agg(F.count(F.lit(1)).alias("files"))


def analysis_counters(files: DataFrame) -> DataFrame:
    """How many files have any text, of how many."""
    return with_text_facts(files).agg(
        F.count_if(F.col("content_chars") > 0).alias("analysed"),
        F.count(F.lit(1)).alias("total"),
    )


def status_label(status: Column) -> Column:
    """Display name; codes without one pass through."""
    pairs = [F.lit(x) for kv in STATUS_LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), status)


def storage_label(is_cloud: Column) -> Column:
    return F.when(F.coalesce(is_cloud, F.lit(0)) != 0, CLOUD_LABEL).otherwise(LOCAL_LABEL)


def page_progress(page: Column, total: Column) -> Column:
    """``page/total`` or empty while the total is unknown."""
    return F.when(total > 0, F.concat_ws("/", page, total)).otherwise("")


def percent(done: Column, total: Column, unknown: float) -> Column:
    return F.when(total > 0, done * F.lit(100.0) / total).otherwise(F.lit(unknown))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def listing_note(rows: DataFrame, limit: int) -> DataFrame:
    """Number of rows shown and whether the listing limit was reached."""
    return rows.agg(F.count(F.lit(1)).alias("shown")).withColumn(
        "limit_reached", F.col("shown") >= limit
    )
