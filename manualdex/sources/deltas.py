"""A catalog as a base and changes: a version costs what it changes, not what the catalog holds.

A version writes its new and edited rows (``changes/version=n``) and the ids whose earlier rows no longer hold
(``removed/version=n``), and then one log entry, created only if there is none of that number yet, so that of
two writers one fails and readers never see half a version. Reading takes base and changes and leaves out rows
whose id a later version removed: the ids since the base are broadcast, and texts are never shuffled. Their number is
bounded, as a version that passes ``MOST_REMOVED`` writes a new base.

Beside each version lies a tally of rows by extension, status and presence of a text. It is the
tally before plus the signed changes, so status reports read a few rows and not the catalog.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.operators import status as S
from manualdex.schema import OCR_EXTENSIONS, OCR_STATUSES
from manualdex.session import cut_lineage
from manualdex.sources import catalog as C

#: Removed ids since the base (about 16 bytes each in a broadcast) beyond which a version writes a new base.
MOST_REMOVED = 1 << 20
_TALLY = ("extension", "extraction_status", "has_text")
_LOG = "version long, base long, removed long"


@dataclass(frozen=True)
class Version:
    version: int
    base: int
    #: Removed ids since the base.
    removed: int


class VersionTaken(RuntimeError):
    """Another writer has written this version."""


def _log(spark: SparkSession, root: str, entry: Version) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/{entry.version:012d}.json")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        raise VersionTaken(str(entry.version))
    try:
        out = store.create(path, False)
    except Exception as e:
        raise VersionTaken(str(entry.version)) from e
    out.write(bytearray(json.dumps(entry.__dict__).encode()))
    out.close()


def at_version(spark: SparkSession, root: str, version: int | None = None) -> Version:
    """The newest version, or the one asked for."""
    entries = spark.read.schema(_LOG).json(f"{root}/log")
    if version is not None:
        entries = entries.filter(F.col("version") == version)
    row = entries.agg(F.max(F.struct("version", "base", "removed")).alias("v")).first()["v"]
    if row is None:
        raise ValueError(f"no version {version or ''} below {root}")
    return Version(**row.asDict())


def _tally(rows: DataFrame, sign: int) -> DataFrame:
    return (
        C.with_text_facts(rows)
        .select("extension", "extraction_status", (F.col("content_chars") > 0).alias("has_text"))
        .groupBy(*_TALLY)
        .agg((F.count(F.lit(1)) * sign).alias("files"))
    )


def _write_tally(parts: DataFrame, root: str, version: int) -> None:
    total = parts.groupBy(*_TALLY).agg(F.sum("files").alias("files")).filter("files <> 0")
    total.write.mode("overwrite").parquet(f"{root}/tally/version={version:08d}")


def create(files: DataFrame, root: str) -> Version:
    """Write a catalog as the first base."""
    path = C.snapshot_path(root, 1)
    C.with_search_keys(C.with_text_facts(files)).write.mode("overwrite").parquet(path)
    _write_tally(_tally(files.sparkSession.read.parquet(path), 1), root, 1)
    entry = Version(1, 1, 0)
    _log(files.sparkSession, root, entry)
    return entry


def _since(spark: SparkSession, root: str, name: str, v: Version) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.filter((F.col("version") > v.base) & (F.col("version") <= v.version))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest unless one is named."""
    v = at_version(spark, root, version)
    base = C.read_snapshot(spark, root, v.base)
    if v.version == v.base:
        return base
    rows = base.withColumn("_version", F.lit(v.base).cast("int")).unionByName(
        _since(spark, root, "changes", v).withColumnRenamed("version", "_version"), allowMissingColumns=True
    )
    gone = _since(spark, root, "removed", v).groupBy("id").agg(F.max("version").alias("_until"))
    gone = F.broadcast(gone.withColumnRenamed("id", "_gone"))
    live = rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("_version") < F.col("_until")), "left_anti")
    return live.drop("_version")


def commit(
    spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame, most_removed: int = MOST_REMOVED
) -> Version:
    """Write a version: ``changed`` has the whole new and edited rows, ``removed`` the ids to drop.

    An id in both is edited, not dropped. Repeating a failed commit overwrites what it left.
    """
    v = at_version(spark, root)
    n = v.version + 1
    folder = f"version={n:08d}"
    C.with_search_keys(C.with_text_facts(changed)).write.mode("overwrite").parquet(f"{root}/changes/{folder}")
    written = spark.read.parquet(f"{root}/changes/{folder}")
    ids = written.select("id").union(removed.select("id")).distinct()
    before = read(spark, root)
    known = before.select("id").join(_small(ids, most_removed), "id", "left_semi")
    known.write.mode("overwrite").parquet(f"{root}/removed/{folder}")
    gone = spark.read.parquet(f"{root}/removed/{folder}")
    total = v.removed + gone.count()
    old = _tally(before.join(_small(gone, most_removed), "id", "left_semi"), -1)
    kept = spark.read.parquet(f"{root}/tally/version={v.version:08d}")
    _write_tally(kept.unionByName(old).unionByName(_tally(written, 1)), root, n)
    entry = Version(n, v.base, total)
    _log(spark, root, entry)
    return compact(spark, root) if total > most_removed else entry


def _small(ids: DataFrame, bound: int) -> DataFrame:
    """Broadcast ids that are written and counted to be within the bound; more of them are left to the planner."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= bound else ids


def compact(spark: SparkSession, root: str) -> Version:
    """A new version with the same rows as one base."""
    v = at_version(spark, root)
    n = v.version + 1
    read(spark, root).write.mode("overwrite").parquet(C.snapshot_path(root, n))
    tally = spark.read.parquet(f"{root}/tally/version={v.version:08d}")
    tally.write.mode("overwrite").parquet(f"{root}/tally/version={n:08d}")
    entry = Version(n, n, 0)
    _log(spark, root, entry)
    return entry


def tally(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``extension``, ``extraction_status``, ``has_text``, ``files`` of a version."""
    return spark.read.parquet(f"{root}/tally/version={at_version(spark, root, version).version:08d}")


def status_counts(tallied: DataFrame) -> DataFrame:
    """As ``status.counts`` of the catalog."""
    name = F.coalesce(F.nullif("extraction_status", F.lit("")), F.lit("pending"))
    return tallied.groupBy(name.alias("status")).agg(F.sum("files").alias("files"))


def database_summary(tallied: DataFrame) -> DataFrame:
    """As ``status.summary`` of the catalog."""
    names = ("ok", "ocr", "error", "pending", "unsupported")
    none = F.lit(0).cast("long")
    return tallied.agg(
        F.coalesce(F.sum("files"), none).alias("total"),
        *[F.coalesce(F.sum(F.when(S.status_filter(n), F.col("files"))), none).alias(n) for n in names],
    )


def ocr_pending_count(tallied: DataFrame) -> DataFrame:
    """As ``status.ocr_pending_count`` of the catalog."""
    waiting = F.col("extension").isin(*OCR_EXTENSIONS) & F.col("extraction_status").isin(*OCR_STATUSES)
    return tallied.filter(waiting).agg(F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"))


def analysis_counters(tallied: DataFrame) -> DataFrame:
    """As ``status.analysis_counters`` of the catalog."""
    none = F.lit(0).cast("long")
    return tallied.agg(
        F.coalesce(F.sum(F.when(F.col("has_text"), F.col("files"))), none).alias("analysed"),
        F.coalesce(F.sum("files"), none).alias("total"),
    )
