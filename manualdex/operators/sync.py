"""Incremental catalog upkeep: compare a folder listing with the catalog and apply it.

Only catalog columns without the text take part. Text lengths stored beside the text
answer every rule that asks about it, so the joins move narrow rows keyed by path, and
paths are unique on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.functions import text as X
from manualdex.operators.numbering import number_rows
from manualdex.schema import (
    CATALOG,
    EXTRACTABLE_EXTENSIONS,
    IMAGE_EXTENSIONS,
    IMAGE_QUEUE_FLAG,
    MAX_ERROR_CHARS,
    MIN_PDF_TEXT_CHARS,
    MIN_TEXT_CHARS,
    OCR_STATUSES,
)
from manualdex.session import cut_lineage
from manualdex.sources.catalog import TEXT_FACTS, with_text_facts

STATE = (
    "id", "filename", "filepath", "extension", "size", "modified", "is_cloud",
    "extraction_status", "extraction_error", "ocr_page", "ocr_total_pages", "file_hash", "ocr_updated",
    "content_chars", "trimmed_chars", "stripped_chars",
)
APPLIED = (*STATE, "sync_action", "should_extract", "dirty")
LISTED = ("filename", "extension", "size", "modified", "is_cloud")

# Error texts.
HYDRATE_ERROR = "Hydrate error: "
EXTRACTION_ERROR = "Extraction error: "
TOO_LITTLE_TEXT = ("Извлечено слишком мало текста: ", " символов")


def extractable(extension: Column) -> Column:
    return F.coalesce(F.lower(extension), F.lit("")).isin(*EXTRACTABLE_EXTENSIONS)


def needs_extraction(can: Column, status: Column, stripped_chars: Column) -> Column:
    """Whether text must be read: not while waiting for recognition, not after an error,
    not when a usable text is there."""
    settled = (
        status.isin(*OCR_STATUSES, "error")
        | ((status == "ok") & (F.coalesce(stripped_chars, F.lit(0)) >= MIN_TEXT_CHARS))
    )
    return can & ~F.coalesce(settled, F.lit(False))


def under(root: str, path: Column) -> Column:
    """The root itself or anything below it, compared by whole path components."""
    root = root.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")


def sheltered(paths: DataFrame, failed: DataFrame) -> DataFrame:
    """The ``filepath``s at or below a path that could not be read (``failed``: path).

    Each path is compared with its own ancestors by an equi-join, so neither side is broadcast.
    """
    parts = F.split("filepath", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return (
        paths.select("filepath", F.explode(above).alias("path"))
        .join(failed.select(F.rtrim("path", F.lit("/")).alias("path")).replace("", "/"), "path", "left_semi")
        .select("filepath")
        .distinct()
    )


def missing(
    catalog: DataFrame, listing: DataFrame, root: str, failed: DataFrame | None = None
) -> DataFrame:
    """Catalog rows below the root whose file is gone. Rows at or below a ``failed`` path, which the
    listing could not read, are not known to be gone."""
    gone = (
        catalog.filter(under(root, F.col("filepath")))
        .join(listing.select("filepath"), "filepath", "left_anti")
        .select("id", "filepath")
    )
    return gone if failed is None else gone.join(sheltered(gone, failed), "filepath", "left_anti").select("id", "filepath")


def narrow_state(catalog: DataFrame) -> DataFrame:
    """The catalog without its texts; columns that an older catalog lacks are null."""
    rows = with_text_facts(catalog)
    absent = {c: F.lit(None).cast(CATALOG[c].dataType) for c in STATE if c not in rows.columns}
    return rows.withColumns(absent).select(*STATE) if absent else rows.select(*STATE)


def classify(
    catalog: DataFrame,
    listing: DataFrame,
    root: str,
    listed_only: bool = False,
    failed: DataFrame | None = None,
) -> DataFrame:
    """Every catalog or listed path with its action and whether to read its text.

    ``listed_only`` leaves out catalog rows the listing does not name, for listings that
    arrive in parts: the catalog is cut to the listed paths by a semi-join, which broadcasts them while their
    written table is small, and only what is left is joined. ``failed`` (path) are paths that could
    not be listed; rows at or below them are kept.
    """
    state = narrow_state(catalog)
    if listed_only:
        state = state.join(listing.select("filepath"), "filepath", "left_semi")
    old = state.select("filepath", F.struct(*[c for c in STATE if c != "filepath"]).alias("old"))
    new = listing.select("filepath", F.struct(*LISTED).alias("new"))
    both = old.join(new, "filepath", "right" if listed_only else "full_outer")

    o, n = F.col("old"), F.col("new")
    unknown = F.lit(False)
    if failed is not None:
        unlisted = both.filter(n.isNull() & under(root, F.col("filepath"))).select("filepath")
        kept = sheltered(unlisted, failed).withColumn("unknown", F.lit(True))
        both = both.join(kept, "filepath", "left")
        unknown = F.coalesce("unknown", F.lit(False))
    cloud = (F.coalesce(o["is_cloud"], F.lit(0)) != 0) | (F.coalesce(n["is_cloud"], F.lit(0)) != 0)
    resized = ~o["size"].eqNullSafe(n["size"])
    touched = resized | ~o["modified"].eqNullSafe(n["modified"])
    action = (
        F.when(n.isNull() & under(root, F.col("filepath")) & ~unknown, "missing")
        .when(n.isNull(), "kept")
        .when(o.isNull(), "new")
        .when((o["extraction_status"] == "error") & ~resized, "error_locked")
        .when(touched, "changed")
        .otherwise("unchanged")
    )
    can = extractable(n["extension"])
    # An unchanged file of an unreadable type counts as read when its text is usable.
    standing = F.when(can, o["extraction_status"]).otherwise(
        F.when(o["stripped_chars"] >= MIN_TEXT_CHARS, "ok").otherwise("unsupported")
    )
    rows = both.withColumns({"sync_action": action, "cloud": cloud, "touched": touched})
    a = F.col("sync_action")
    return rows.withColumns(
        {
            "extractable": F.coalesce(can & n.isNotNull(), F.lit(False)),
            "refresh": (a == "error_locked")
            & (touched | ((F.coalesce(o["is_cloud"], F.lit(0)) != 0) != F.col("cloud"))),
            "should_extract": F.when(a.isin("new", "changed"), can)
            .when(a == "unchanged", needs_extraction(can, standing, o["stripped_chars"]))
            .otherwise(F.lit(False)),
        }
    )


def _state_after(rows: DataFrame) -> DataFrame:
    """Row state after the listing is applied, before any text is read."""
    o, n, a = F.col("old"), F.col("new"), F.col("sync_action")
    fresh = a.isin("new", "changed")
    relisted = fresh | F.col("refresh")
    no_text = (
        (a == "unchanged") & ~F.col("extractable") & (o["trimmed_chars"] < MIN_TEXT_CHARS)
    )
    state = {c: F.when(relisted, n[c]).otherwise(o[c]) for c in LISTED if c != "is_cloud"}
    state["is_cloud"] = F.when(a == "kept", o["is_cloud"]).otherwise(F.col("cloud").cast("int"))
    state["extraction_status"] = (
        F.when(fresh, F.when(F.col("extractable"), "pending").otherwise("unsupported"))
        .when(no_text, "unsupported")
        .otherwise(o["extraction_status"])
    )
    state["extraction_error"] = F.when(~(fresh | no_text), o["extraction_error"])
    for c in ("ocr_page", "ocr_total_pages", "content_chars", "trimmed_chars", "stripped_chars"):
        state[c] = F.when(fresh, 0).otherwise(o[c])
    state["file_hash"] = o["file_hash"]
    state["ocr_updated"] = F.when(~fresh, o["ocr_updated"])
    recloud = ~state["is_cloud"].eqNullSafe(o["is_cloud"])
    return rows.select(
        o["id"].alias("id"), "filepath", "sync_action", "should_extract",
        F.coalesce(relisted | no_text | recloud, F.lit(True)).alias("dirty"),
        *[v.alias(k) for k, v in state.items()],
    )


def listed_state(classified: DataFrame) -> DataFrame:
    """New state of the listed rows; rows new to the catalog have no id yet."""
    return _state_after(classified).select(*APPLIED)


def apply(classified: DataFrame, next_id: int) -> DataFrame:
    """New catalog state: missing rows dropped, new rows numbered after ``next_id``."""
    state = _state_after(classified.filter(F.col("sync_action") != "missing"))
    known = state.filter(F.col("sync_action") != "new").select(*APPLIED)
    added = number_rows(
        state.filter(F.col("sync_action") == "new").drop("id"), [F.col("filepath")], "id", next_id
    )
    return known.unionByName(added.withColumn("id", F.col("id").cast("long")).select(*APPLIED))


def max_id(catalog: DataFrame) -> int:
    return catalog.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]


def sync(
    catalog: DataFrame, listing: DataFrame, root: str, failed: DataFrame | None = None
) -> DataFrame:
    return apply(classify(catalog, listing, root, failed=failed), max_id(catalog))


def pdf_layer_results(layers: DataFrame) -> DataFrame:
    """Extraction results of PDF text layers (filepath, text, total_pages): a layer of too
    few characters asks for recognition and keeps its text as a preview."""
    enough = X.has_stripped_chars(F.col("text"), MIN_PDF_TEXT_CHARS)
    return layers.select(
        "filepath",
        F.when(enough, F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("failure"),
        F.lit(None).cast("string").alias("failure_kind"),
        (~enough).alias("ocr_required"),
        F.when(~enough, F.coalesce("text", F.lit(""))).alias("preview"),
        "total_pages",
    )


def with_outcomes(state: DataFrame, results: DataFrame) -> DataFrame:
    """State after the texts of ``should_extract`` files were read.

    ``results``: filepath, text, failure, failure_kind (hydrate, stopped or extraction),
    ocr_required, preview, total_pages. Images are queued for recognition without a result.
    """
    r = F.col("r")
    run = F.col("should_extract")
    text = F.coalesce(r["text"], F.lit(""))
    chars = F.char_length(X.strip(text))
    image = F.lower(F.regexp_extract("filepath", r"[^/](\.[^./]+)\z", 1)).isin(*IMAGE_EXTENSIONS)
    kind = r["failure_kind"]
    preview = F.when(
        F.char_length(X.strip(F.coalesce(r["preview"], F.lit("")))) >= MIN_TEXT_CHARS, r["preview"]
    )
    outcome = (
        F.when(~run, "none")
        .when(image, "image_queued")
        .when(kind == "hydrate", "hydrate_error")
        .when(kind == "stopped", "stopped")
        .when(F.coalesce(r["ocr_required"], F.lit(False)), "ocr_queued")
        .when(kind == "extraction", "extraction_error")
        .when(chars < MIN_TEXT_CHARS, "too_little")
        .otherwise("ok")
    )
    narrow = results.select("filepath", F.struct(*[c for c in results.columns if c != "filepath"]).alias("r"))
    rows = state.join(narrow, "filepath", "left").withColumn("outcome", outcome)

    w = F.col("outcome")
    error = (
        F.when(w == "hydrate_error", F.concat(F.lit(HYDRATE_ERROR), r["failure"]))
        .when(w == "extraction_error", F.concat(F.lit(EXTRACTION_ERROR), r["failure"]))
        .when(w == "too_little", F.concat(F.lit(TOO_LITTLE_TEXT[0]), chars, F.lit(TOO_LITTLE_TEXT[1])))
    )
    queued = w.isin("image_queued", "ocr_queued")
    new_text = F.when(w == "ok", text).when(w == "ocr_queued", preview)
    replaced = queued | (w == "ok")

    def length(measure: Column, kept: str) -> Column:
        return F.when(replaced, F.coalesce(measure, F.lit(0))).otherwise(F.col(kept))

    return rows.withColumn("_text", new_text).withColumns(
        {
            "extraction_status": F.when(w == "none", F.col("extraction_status"))
            .when(queued, "ocr_pending")
            .when(w == "stopped", "pending")
            .when(w == "ok", "ok")
            .otherwise("error"),
            "extraction_error": F.when(w == "none", F.col("extraction_error")).otherwise(
                F.substring(error, 1, MAX_ERROR_CHARS)
            ),
            "ocr_page": F.when(replaced, 0).otherwise(F.col("ocr_page")),
            "ocr_total_pages": F.when(w == "ocr_queued", F.coalesce(r["total_pages"], F.lit(0)))
            .when(replaced, 0)
            .otherwise(F.col("ocr_total_pages")),
            "ocr_updated": F.when(~replaced, F.col("ocr_updated")),
            "content_chars": length(F.char_length("_text"), "content_chars"),
            "trimmed_chars": length(F.char_length(F.trim("_text")), "trimmed_chars"),
            "stripped_chars": length(F.char_length(X.strip(F.col("_text"))), "stripped_chars"),
            "new_content": F.col("_text"),
            "success": replaced,
        }
    ).select(
        *STATE, "sync_action", "should_extract", "outcome", "success", "new_content",
        (F.col("dirty") | (w != "none")).alias("dirty"),
    )


def counters(classified: DataFrame, results: DataFrame) -> DataFrame:
    """Added, updated, skipped, deleted, total.

    A changed file whose text is then read counts twice as updated, and queueing for
    recognition counts as success.
    """
    state = _state_after(classified)
    done = with_outcomes(state, results)
    a = F.col("sync_action")
    listed = ~a.isin("missing", "kept")
    return done.agg(
        F.count_if(a == "new").alias("added"),
        (
            F.count_if(a == "changed") + F.count_if(F.col("success") & (a != "new"))
        ).alias("updated"),
        F.count_if(listed & ~F.col("should_extract")).alias("skipped"),
        F.count_if(a == "missing").alias("deleted"),
        F.count_if(listed).alias("total"),
    )


def _edits(after: DataFrame) -> DataFrame:
    """The new state of edited rows as one struct, and whether the stored text goes."""
    cleared = F.col("sync_action").isin("new", "changed") | F.col("success")
    touched = after.filter(F.col("dirty") & (F.col("sync_action") != "new"))
    return touched.select(
        "id", F.struct(*[c for c in STATE if c != "id"], cleared.alias("cleared"), "new_content").alias("edit")
    )


def _stored(catalog: DataFrame) -> DataFrame:
    """Catalog rows with every column of the state."""
    absent = [c for c in STATE if c not in (*catalog.columns, *TEXT_FACTS)]
    filled = with_text_facts(catalog)
    return filled.withColumns({c: F.lit(None).cast(CATALOG[c].dataType) for c in absent}) if absent else filled


def _with_edits(rows: DataFrame) -> DataFrame:
    """Rows with their ``edit``, where they have one, put in."""
    edit, edited = F.col("edit"), F.col("edit").isNotNull()
    content = F.when(edit["cleared"], edit["new_content"]).otherwise(F.col("content"))
    return rows.select(
        "id",
        *[F.when(edited, edit[c]).otherwise(F.col(c)).alias(c) for c in STATE if c != "id"],
        content.alias("content"),
        # Search keys of edited rows are made anew when the version is written.
        *([F.when(~edited, F.col("keys")).alias("keys")] if "keys" in rows.columns else []),
    )


def _new_rows(after: DataFrame) -> DataFrame:
    return after.filter(F.col("sync_action") == "new").select(*STATE, F.col("new_content").alias("content"))


def next_snapshot(catalog: DataFrame, after: DataFrame, gone: DataFrame) -> DataFrame:
    """Full catalog rows, text included, for the next written version.

    Only rows the sync touched take part in a join, as a written table whose size the
    planner knows: while it is small the texts of all other rows stay where they are.
    ``after`` is the state with ``new_content`` of files that were read; ``gone`` holds the
    ids to drop. Rows keep their stored text unless the sync cleared or replaced it.
    """
    edits = cut_lineage(
        _edits(after)
        .withColumn("gone", F.lit(False))
        .unionByName(gone.select("id", F.lit(True).alias("gone")), allowMissingColumns=True)
    )
    kept = _stored(catalog).join(edits, "id", "left").filter(~F.coalesce("gone", F.lit(False)))
    return _with_edits(kept).unionByName(_new_rows(after), allowMissingColumns=True)


def changed_rows(catalog: DataFrame, after: DataFrame) -> DataFrame:
    """Whole rows that the sync added or edited, for a version that writes its changes alone.

    The catalog is first cut to the edited ids, so that of other rows no text reaches the join.
    """
    edits = cut_lineage(_edits(after))
    rows = _stored(catalog).join(edits.select("id"), "id", "left_semi").join(edits, "id")
    return _with_edits(rows).unionByName(_new_rows(after), allowMissingColumns=True)


def repair(old: DataFrame, image_queue_done: bool) -> DataFrame:
    """Bring an older catalog to the current columns and consistent statuses.

    Columns are added with their defaults, interrupted recognition waits again, short
    image texts are queued once, and short texts marked ok are read again, in this order.
    """
    defaults = {
        "content": F.lit(None).cast("string"),
        "file_hash": F.lit(None).cast("string"),
        "is_cloud": F.lit(0),
        "extraction_status": F.lit("pending"),
        "extraction_error": F.lit(None).cast("string"),
        "ocr_page": F.lit(0),
        "ocr_total_pages": F.lit(0),
        "ocr_updated": F.lit(None).cast("double"),
    }
    df = old.withColumns({c: v for c, v in defaults.items() if c not in old.columns})
    df = with_text_facts(df).withColumns(
        {
            "ocr_page": F.coalesce("ocr_page", F.lit(0)),
            "ocr_total_pages": F.coalesce("ocr_total_pages", F.lit(0)),
        }
    )
    status = F.col("extraction_status")
    short = F.col("trimmed_chars") < MIN_TEXT_CHARS
    df = df.withColumn(
        "extraction_status", F.when(status == "ocr_processing", "ocr_pending").otherwise(status)
    )
    if not image_queue_done:
        requeue = F.coalesce(
            F.col("extension").isin(*IMAGE_EXTENSIONS)
            & status.isin("pending", "processing", "error", "ok")
            & short,
            F.lit(False),
        )
        df = df.withColumn("_requeue", requeue).withColumns(
            {
                "extraction_status": F.when(F.col("_requeue"), "ocr_pending").otherwise(status),
                "extraction_error": F.when(~F.col("_requeue"), F.col("extraction_error")),
                "ocr_page": F.when(F.col("_requeue"), 0).otherwise(F.col("ocr_page")),
                "ocr_total_pages": F.when(F.col("_requeue"), 0).otherwise(F.col("ocr_total_pages")),
                "ocr_updated": F.when(~F.col("_requeue"), F.col("ocr_updated")),
            }
        ).drop("_requeue")
    return df.withColumn(
        "extraction_status", F.when((status == "ok") & short, "pending").otherwise(status)
    )


def repair_flags(meta: DataFrame) -> DataFrame:
    """Metadata after a repair: the one-time image queueing is marked as done."""
    spark = meta.sparkSession
    flag = spark.range(1).select(F.lit(IMAGE_QUEUE_FLAG).alias("key"), F.lit("1").alias("value"))
    return meta.unionByName(flag.join(meta.select("key"), "key", "left_anti"))
