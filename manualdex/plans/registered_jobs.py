"""Registered file-reading and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from manualdex.plans.registered_catalog import NOW
from manualdex.sources import derived as D
from manualdex.sources import folder as Fo
from manualdex.streaming import jobs as J


def _scan_folder(spark, sf):
    """All files of the written folder but the checksums that the file system keeps beside them."""
    files = Fo.scan_folder(spark, D.text_folder(spark, sf)).filter(~F.col("filename").startswith("."))
    lang = F.regexp_extract("filepath", "/lang=([^/]+)/", 1).alias("lang")
    return files.groupBy(lang, "extension", "is_cloud", "extractable").agg(F.sum("size").alias("bytes"))


def _folder_text(spark, sf):
    read = Fo.decode_text(Fo.read_binary(spark, D.text_folder(spark, sf)))
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return read.groupBy(lang).agg(F.sum(F.char_length("text")).alias("chars"))


def _office(spark, sf):
    return Fo.extract_office_text(D.office_files(spark, sf))


def _stream_sync(spark, sf):
    return J.stream_sync(D.scan_stream(spark, sf), D.catalog(spark, sf), "/lib").drop("dirty")


def _stream_pages(spark, sf):
    return J.stream_ocr_pages(D.ocr_page_stream(spark, sf), D.catalog(spark, sf), now=NOW)


def _stream_status(spark, sf):
    return J.stream_status_counts(D.files_stream(spark, sf))


FILES = {
    "scan_folder": _scan_folder,
    "folder_text": _folder_text,
    "decode_text": lambda spark, sf: Fo.decode_text(D.raw_texts(spark, sf)).select("id", "text"),
    "extract_office_text": _office,
}

STREAMS = {
    "stream_sync": _stream_sync,
    "stream_ocr_pages": _stream_pages,
    "stream_status_counts": _stream_status,
}

PARTS = [FILES, STREAMS]
