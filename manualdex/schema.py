"""Catalog table, statuses and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.DoubleType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("is_cloud", T.IntegerType()),
        T.StructField("extraction_status", T.StringType()),
        T.StructField("extraction_error", T.StringType()),
        T.StructField("ocr_page", T.IntegerType()),
        T.StructField("ocr_total_pages", T.IntegerType()),
        T.StructField("ocr_updated", T.DoubleType()),
    ]
)

META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

# Extension sets, limits and status groups.
EXTRACTABLE_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".odt", ".ods", ".txt", ".csv", ".json",
    ".jpg", ".jpeg", ".png", ".tif", ".tiff",
)
TEXT_BEARING_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".odt", ".ods", ".txt", ".csv", ".json",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
OCR_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff")
OFFICE_EXTENSIONS = (".doc", ".docx", ".xls", ".xlsx", ".odt", ".ods")
PLAIN_TEXT_EXTENSIONS = (".txt", ".csv", ".json")
MIN_TEXT_CHARS = 10
MIN_PDF_TEXT_CHARS = 80
MAX_ERROR_CHARS = 2000
OCR_STATUSES = ("ocr_pending", "ocr_processing")
PENDING_STATUSES = ("pending", "processing")
IMAGE_QUEUE_FLAG = "image_ocr_queue_v13"

# Cloud storage attribute bits.
ATTRIBUTE_PINNED = 0x00080000
ATTRIBUTE_CLOUD_BITS = (0x00000400, 0x00001000, 0x00040000, 0x00100000, 0x00400000)
ATTRIBUTE_UNREADABLE = 0xFFFFFFFF
