"""Registered queries over catalog state: status, duplicates, sync, recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from manualdex.operators import duplicates, ocr, status, sync
from manualdex.operators.sync import STATE
from manualdex.session import cut_lineage, run_folder
from manualdex.sources import catalog as C
from manualdex.sources import deltas
from manualdex.sources import derived as D

ROOT = "/lib"


def _status_filter(name: str):
    return lambda spark, sf: D.catalog(spark, sf).filter(status.status_filter(name)).select("id")


#: Rows of the bounded listings.
SHOWN = 100


def _status_files(name: str, limit: int | None = None):
    return lambda spark, sf: status.listing(D.catalog(spark, sf), name, limit)


def _on_catalog(fn):
    return lambda spark, sf: fn(D.catalog(spark, sf))


def _on_dups(fn):
    return lambda spark, sf: fn(D.dup_files(spark, sf))


def _status_labels(spark, sf):
    return D.catalog(spark, sf).select(
        "id",
        status.status_label(F.coalesce("extraction_status", F.lit("pending"))).alias("status_label"),
        status.storage_label(F.col("is_cloud")).alias("storage_label"),
    )


def _listing_note(spark, sf):
    return status.listing_note(status.listing(D.catalog(spark, sf), limit=SHOWN), SHOWN)


def _progress(spark, sf):
    done, total = F.col("ocr_page"), F.col("ocr_total_pages")
    return D.catalog(spark, sf).select(
        "id",
        status.page_progress(done, total).alias("pages"),
        status.one_decimal(status.percent(done, total, 0.0)).alias("page_percent"),
        status.one_decimal(status.percent(done, total, 100.0)).alias("work_percent"),
    )


STATUS = {
    **{
        f"status_filter_{n}": _status_filter(n)
        for n in ("all", "ok", "ocr", "error", "pending", "unsupported")
    },
    "status_files": _status_files("all"),
    "status_files_ocr": _status_files("ocr"),
    "status_files_error": _status_files("error"),
    "status_files_pending": _status_files("pending"),
    "status_files_first": _status_files("all", SHOWN),
    "status_counts": _on_catalog(status.counts),
    "database_summary": _on_catalog(status.summary),
    "ocr_pending_count": _on_catalog(status.ocr_pending_count),
    "analysis_counters": _on_catalog(status.analysis_counters),
    "status_labels": _status_labels,
    "status_note": _listing_note,
    "ocr_progress": _progress,
    "lookup_by_id": lambda spark, sf: C.lookup(D.catalog(spark, sf), 12, 150, 777).select(
        "id", "filepath", "is_cloud", "content"
    ),
}


def _content_hash(spark, sf):
    return D.dup_files(spark, sf).select("id", F.sha2(F.col("content"), 256).alias("hash"))


DUPLICATES = {
    "content_hash": _content_hash,
    "duplicates": _on_dups(
        lambda df: duplicates.members(df).select("hash", "id", "filename", "filepath", "is_first")
    ),
    "duplicate_groups": _on_dups(lambda df: duplicates.groups(duplicates.keyed(df))),
    "duplicate_rows": _on_dups(duplicates.listing),
    "duplicate_summary": _on_dups(duplicates.summary),
}


def _classified(spark, sf):
    return sync.classify(D.catalog(spark, sf), D.scan(spark, sf), ROOT)


def _sync_classify(spark, sf):
    return _classified(spark, sf).select(
        "filepath", "sync_action", "cloud", "extractable", "refresh", "should_extract"
    )


def _synced(spark, sf):
    return sync.sync(D.catalog(spark, sf), D.scan(spark, sf), ROOT)


def _outcome(spark, sf):
    return sync.with_outcomes(_synced(spark, sf), D.extraction_results(spark, sf)).drop("dirty")


def _counters(spark, sf):
    return sync.counters(_classified(spark, sf), D.extraction_results(spark, sf))


def _snapshot(spark, sf):
    root = run_folder(spark, "snapshot")
    catalog, gone = D.catalog(spark, sf), sync.missing(D.catalog(spark, sf), D.scan(spark, sf), ROOT)
    after = cut_lineage(sync.with_outcomes(_synced(spark, sf), D.extraction_results(spark, sf)))
    C.publish(sync.next_snapshot(catalog, after, gone), root, 2)
    return C.read_current(spark, root).select(
        *[c for c in STATE if not c.endswith("_chars")], F.sha2("content", 256).alias("content_hash")
    )


def _delta_root(spark, sf):
    """A catalog with one sync committed as changes."""
    root = run_folder(spark, "deltas")
    catalog = D.catalog(spark, sf)
    deltas.create(catalog, root)
    gone = sync.missing(catalog, D.scan(spark, sf), ROOT)
    after = cut_lineage(sync.with_outcomes(_synced(spark, sf), D.extraction_results(spark, sf)))
    deltas.commit(spark, root, sync.changed_rows(deltas.read(spark, root), after), gone)
    return root


def _delta_snapshot(spark, sf, compacted=False):
    root = _delta_root(spark, sf)
    if compacted:
        deltas.compact(spark, root)
    return deltas.read(spark, root).select(
        *[c for c in STATE if not c.endswith("_chars")], F.sha2("content", 256).alias("content_hash")
    )


def _delta_tally(report):
    return lambda spark, sf: report(deltas.tally(spark, _delta_root(spark, sf)))


def _needs(spark, sf):
    return D.catalog(spark, sf).select(
        "id",
        sync.needs_extraction(
            sync.extractable(F.col("extension")), F.col("extraction_status"), F.col("stripped_chars")
        ).alias("needs_extraction"),
    )


def _repair(spark, sf):
    return sync.repair(D.old_files(spark, sf), image_queue_done=False).select(
        "id", "extension", "is_cloud", "extraction_status", "extraction_error", "ocr_page",
        "ocr_total_pages", "ocr_updated", "file_hash", "content_chars",
    )


def _flags(spark, sf):
    path = run_folder(spark, "meta")
    C.write_meta(D.metadata(spark, sf), path)
    return sync.repair_flags(C.read_meta(spark, path))


def _pdf_layers(spark, sf):
    layers = D.catalog(spark, sf).filter(F.col("extension") == ".pdf").select(
        "filepath", F.col("content").alias("text"), F.lit(4).alias("total_pages")
    )
    return sync.pdf_layer_results(layers).drop("failure", "failure_kind")


SYNC = {
    "pdf_text_layer": _pdf_layers,
    "sync_classify": _sync_classify,
    "sync_apply": lambda spark, sf: _synced(spark, sf).select(*STATE, "sync_action", "should_extract"),
    "sync_missing": lambda spark, sf: sync.missing(D.catalog(spark, sf), D.scan(spark, sf), ROOT),
    "sync_missing_unread": lambda spark, sf: sync.missing(
        D.catalog(spark, sf), D.scan(spark, sf), ROOT, D.unread_folders(spark, sf)
    ),
    "sync_apply_unread": lambda spark, sf: sync.sync(
        D.catalog(spark, sf), D.scan(spark, sf), ROOT, D.unread_folders(spark, sf)
    ).select(*STATE, "sync_action", "should_extract"),
    "metadata_flags": _flags,
    "sync_counters": _counters,
    "extraction_outcome": _outcome,
    "catalog_snapshot": _snapshot,
    "catalog_snapshot_deltas": _delta_snapshot,
    "catalog_snapshot_compacted": lambda spark, sf: _delta_snapshot(spark, sf, compacted=True),
    "status_counts_deltas": _delta_tally(deltas.status_counts),
    "database_summary_deltas": _delta_tally(deltas.database_summary),
    "ocr_pending_count_deltas": _delta_tally(deltas.ocr_pending_count),
    "analysis_counters_deltas": _delta_tally(deltas.analysis_counters),
    "needs_extraction": _needs,
    "catalog_repair": _repair,
}


#: Time of the recognition run, in seconds.
NOW = 1_800_000_000.0


def _ocr_merge(spark, sf):
    return ocr.merge(D.catalog(spark, sf), D.ocr_pages(spark, sf), NOW)


def _ocr_finish(spark, sf):
    return ocr.finish(_ocr_merge(spark, sf), NOW)


OCR = {
    "ocr_queue": _on_catalog(ocr.queue),
    "ocr_merge_pages": _ocr_merge,
    "ocr_finish": _ocr_finish,
    "ocr_run_counters": lambda spark, sf: ocr.run_counters(_ocr_finish(spark, sf)),
    "ocr_stop": lambda spark, sf: ocr.after_stop(D.catalog(spark, sf)).select("id", "extraction_status"),
}

PARTS = [STATUS, DUPLICATES, SYNC, OCR]
