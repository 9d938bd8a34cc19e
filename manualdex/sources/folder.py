"""Folder listings and file contents as tables: listing, text decoding, office texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.functions import scalars as Sc
from manualdex.session import run_folder
from manualdex.sources.office import office_text

ENTRIES_PER_PIECE = 10000


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder; unreadable ones are skipped."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(folder)
    )


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+\z", 0)


def extension_of(filename: Column) -> Column:
    """Lower-case last suffix with its dot; none for ``.name`` and ``name.``."""
    return F.lower(F.regexp_extract(filename, r"(?s)\A.+(\.[^.]+)\z", 1))


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/+", "/")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Direct entries of each directory, in bounded pieces. A path that is there but can't be read gives a
    ``failed`` row; one that is gone gives none."""
    columns = ["path", "filename", "is_dir", "size", "modified", "failed"]
    rows: list[tuple] = []
    for batch in batches:
        for folder in batch["path"]:
            try:
                for entry in os.scandir(folder):
                    try:
                        if entry.is_dir(follow_symlinks=False):
                            rows.append((entry.path, entry.name, True, 0, 0.0, False))
                        elif entry.is_file():
                            stat = entry.stat()
                            rows.append((entry.path, entry.name, False, stat.st_size, stat.st_mtime, False))
                    except FileNotFoundError:
                        continue
                    except OSError:
                        rows.append((entry.path, entry.name, False, 0, 0.0, True))
                    if len(rows) >= ENTRIES_PER_PIECE:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except (FileNotFoundError, NotADirectoryError):
                continue
            except OSError:
                rows.append((folder, os.path.basename(folder), False, 0, 0.0, True))
    yield pd.DataFrame(rows, columns=columns)


def _walk(spark: SparkSession, folder: str) -> DataFrame:
    """All files and failed paths below a mounted folder. Directories of one depth are listed in
    parallel, and each depth is written to the shared folder, so a lost task lists only its share."""
    work = run_folder(spark, "walk")
    schema = "path string, filename string, is_dir boolean, size bigint, modified double, failed boolean"
    folders = spark.createDataFrame([(folder,)], "path string")
    depth, more = 0, True
    while more:
        level = f"{work}/depth={depth}"
        tasks = spark.sparkContext.defaultParallelism
        folders.repartition(tasks).mapInPandas(_entries, schema).write.parquet(level)
        folders = spark.read.schema(schema).parquet(level).filter("is_dir").select("path")
        more, depth = not folders.isEmpty(), depth + 1
    files = spark.read.schema(schema).option("basePath", work).parquet(f"{work}/depth=*")
    return files.filter("NOT is_dir").select(
        "filename", F.col("path").alias("filepath"), "size", "modified", "failed"
    )


def _listed_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an object store or distributed file system, contents pruned. Spark's own
    listing leaves out empty files and names that start with ``_`` or ``.``."""
    try:
        found = read_binary(spark, folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "filename string, filepath string, size bigint, modified double")
    return found.select(
        name_of(F.col("path")).alias("filename"),
        local_path(F.col("path")).alias("filepath"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / F.lit(1e6)).alias("modified"),
    )


def scan_folder(
    spark: SparkSession, folder: str, attributes: DataFrame | None = None
) -> DataFrame:
    """Listing of every file, supported or not; an absent folder gives an empty one."""
    return list_folder(spark, folder, attributes)[0]


def list_folder(
    spark: SparkSession, folder: str, attributes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The listing of a folder, and the paths (``path``) in it that could not be read.

    A path without scheme is a folder mounted on all executors. Of another store Spark's own
    listing fails as a whole when a part can't be read, so it has no failed paths. ``attributes``
    (filepath, attributes) supplies storage attribute bits where they are known.
    """
    if "://" in folder:
        found = _listed_by_source(spark, folder).withColumn("failed", F.lit(False))
    else:
        found = _walk(spark, folder)
    failed = found.filter("failed").select(F.col("filepath").alias("path"))
    rows = found.filter("NOT failed").withColumn("extension", extension_of(F.col("filename")))
    if attributes is None:
        cloud = F.lit(0)
    else:
        rows = rows.join(attributes, "filepath", "left")
        cloud = Sc.is_cloud(F.col("attributes")).cast("int")
    listing = rows.select(
        "filename", "filepath", "extension", "size", "modified", cloud.alias("is_cloud"),
        Sc.is_extractable(F.col("extension")).alias("extractable"),
    )
    return listing, failed


def _high(page: str, without: tuple[int, ...] = ()) -> tuple[str, str]:
    """The upper half of a single-byte code page, next to what Latin-1 reads those bytes as."""
    codes = [b for b in range(0x80, 0x100) if b not in without]
    return "".join(map(chr, codes)), bytes(codes).decode(page)


#: The byte that the first Cyrillic code page leaves open; texts that hold it are in the second.
OPEN_BYTE = 0x98


def _legacy_text(content: Column) -> Column:
    """Single-byte Cyrillic text, read as Latin-1 and translated; the second code page decodes every byte."""
    latin = F.decode(content, "ISO-8859-1")
    first, second = _high("cp1251", (OPEN_BYTE,)), _high("cp866")
    return F.when(latin.contains(chr(OPEN_BYTE)), F.translate(latin, *second)).otherwise(
        F.translate(latin, *first)
    )


def decode_text(files: DataFrame) -> DataFrame:
    """Add ``text`` for a table with a binary ``content`` column.

    Valid UTF-8 is taken as it is, anything else as single-byte Cyrillic text. The byte-order mark is
    dropped and line ends become LF.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), F.regexp_replace(as_text, "\\A\ufeff", "")).otherwise(
        _legacy_text(content)
    )
    return files.withColumn("text", F.regexp_replace(decoded, "\r\n?", "\n"))


def extract_office_text(files: DataFrame) -> DataFrame:
    """(path, text) of ``.docx .xlsx .odt .ods`` contents; unreadable ones give ''.

    Arrow batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``, so large contents travel
    in small batches.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [office_text(e, c) for e, c in zip(batch["extension"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    kinds = (".docx", ".xlsx", ".odt", ".ods")
    rows = files.withColumn("extension", extension_of(name_of(F.col("path")))).filter(
        F.col("extension").isin(*kinds)
    )
    return rows.select("path", "extension", "content").mapInPandas(parse, "path string, text string")


def extract_by_route(files: DataFrame) -> DataFrame:
    """Text of plain and office files together, each through its own reader."""
    routed = files.withColumn("route", Sc.extract_route(extension_of(name_of(F.col("path")))))
    plain = decode_text(routed.filter(F.col("route") == "text")).select("path", "text")
    office = extract_office_text(routed.filter(F.col("route") == "office"))
    return plain.unionByName(office)
