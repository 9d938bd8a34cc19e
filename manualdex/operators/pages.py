"""Which pages a chunk of a document's text comes from, so that sources can be cited by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manualdex.operators.ocr import PAGES_PER_PIECE, fresh_pages
from manualdex.operators.postings import CHUNK_CHARS, document_chunks
from manualdex.session import cut_lineage
from manualdex.sources.catalog import with_text_facts

# Fixed value: how a page is named in a source.
PAGE_LABEL = " — стр. "


def page_spans(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``file_id``, ``page``, ``start``, ``end``: places of the pages in the text after the merge of ``pages``.

    Pages are those that the merge appends: new ones of waiting files, repeated deliveries once. Lengths are
    summed in runs of pages first and then within a run, so a document with most of all pages isn't one
    window. Pages without text have no place. A null page or file gives no row.
    """
    fresh = fresh_pages(files, pages).filter("page IS NOT NULL").select(
        "file_id",
        "page",
        F.floor(F.col("page") / PAGES_PER_PIECE).alias("piece"),
        # A page is appended behind a line end.
        F.when(F.col("p.text") != "", F.char_length("p.text") + 1).otherwise(0).cast("long").alias("taken"),
    )
    fresh = cut_lineage(fresh)
    earlier = Window.partitionBy("file_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = fresh.groupBy("file_id", "piece").agg(F.sum("taken").alias("taken"))
    pieces = pieces.select("file_id", "piece", F.coalesce(F.sum("taken").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file_id", "piece").orderBy("page")
    before = with_text_facts(files).select(F.col("id").alias("file_id"), F.col("content_chars").alias("_base"))
    end = F.col("_base") + F.col("_before") + F.sum("taken").over(within)
    return (
        fresh.join(pieces, ["file_id", "piece"])
        .join(before, "file_id")
        .select("file_id", "page", (end - F.col("taken") + 1).alias("start"), end.alias("end"), "taken")
        .filter("taken > 0")
        .drop("taken")
    )


def _cells(width: int) -> Column:
    """Numbers of the cells of ``width`` characters that a span reaches."""
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return F.sequence(first.cast("int"), last.cast("int"))


def chunks_with_pages(files: DataFrame, spans: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """Numbered chunks with ``page_number`` and ``last_page``, null for a text of no known pages.

    Chunks are equally wide, so the chunks that a page reaches are a range of numbers: the interval join is an
    equal join on file and chunk number.
    """
    reached = spans.select(
        "file_id",
        "page",
        F.explode(_cells(chars)).alias("chunk_index"),
    )
    ranges = reached.groupBy("file_id", "chunk_index").agg(
        F.min("page").alias("page_number"), F.max("page").alias("last_page")
    )
    return document_chunks(files, chars).join(ranges, ["file_id", "chunk_index"], "left").select(
        "file_id", "page_number", "last_page", "chunk_index", "text"
    )


def page_at(places: DataFrame, spans: DataFrame, width: int = CHUNK_CHARS) -> DataFrame:
    """``places`` (``file_id``, ``place``) with the page that holds the place, null where none does."""
    cell = F.floor(F.col("place") / width).cast("int")
    cells = spans.select(
        "file_id",
        "page",
        "start",
        "end",
        F.explode(_cells(width)).alias("cell"),
    )
    held = (
        places.filter("place IS NOT NULL")
        .select("file_id", "place", cell.alias("cell"))
        .join(cells, ["file_id", "cell"])
        .filter("start <= place AND place < end")
        .groupBy("file_id", "place")
        .agg(F.max("page").alias("page"))
    )
    return places.join(held, ["file_id", "place"], "left")
