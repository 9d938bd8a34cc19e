"""SQL for status, duplicate, sync and recognition queries."""

from __future__ import annotations

from manualdex.oracle import common as O

WF = O.WITH_FILES
FILTERS = {
    "all": "TRUE",
    "ok": "extraction_status = 'ok'",
    "ocr": "extraction_status IN ('ocr_pending', 'ocr_processing')",
    "error": "extraction_status = 'error'",
    "pending": "(extraction_status IS NULL OR extraction_status IN ('pending', 'processing'))",
    "unsupported": "extraction_status = 'unsupported'",
}
OCR_EXT = "('.pdf', '.jpg', '.jpeg', '.png', '.tif', '.tiff')"
EXTRACTABLE = (
    "('.pdf', '.doc', '.docx', '.xls', '.xlsx', '.odt', '.ods', '.txt', '.csv', '.json', "
    "'.jpg', '.jpeg', '.png', '.tif', '.tiff')"
)
IMAGES = "('.jpg', '.jpeg', '.png', '.tif', '.tiff')"


def _listing(name: str, order: str, limit: int | None = None) -> str:
    return f"""
{WF} SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position, id, filename, extension,
  coalesce(extraction_status, 'pending') AS status, coalesce(extraction_error, '') AS error, filepath,
  CAST(coalesce(is_cloud, 0) AS INT) AS is_cloud, coalesce(ocr_page, 0) AS ocr_page,
  coalesce(ocr_total_pages, 0) AS ocr_total_pages, CAST(length(coalesce(content, '')) AS INT) AS text_chars
FROM files WHERE {FILTERS[name]}{f' QUALIFY position <= {limit}' if limit else ''}"""


STATUS = {
    **{f"status_filter_{n}": f"{WF} SELECT id FROM files WHERE {c}" for n, c in FILTERS.items()},
    "status_files": _listing("all", "id"),
    "status_files_ocr": _listing(
        "ocr", "CASE WHEN ocr_total_pages > 0 THEN ocr_total_pages ELSE 2147483647 END, id"
    ),
    "status_files_error": _listing("error", "extension NULLS FIRST, filename NULLS FIRST, id"),
    "status_files_pending": _listing("pending", "id"),
    "status_files_first": _listing("all", "id", 100),
    "status_counts": f"""
{WF} SELECT coalesce(nullif(extraction_status, ''), 'pending') AS status, count(*) AS files
FROM files GROUP BY 1""",
    "database_summary": f"""
{WF} SELECT count(*) AS total, {', '.join(f"count(*) FILTER ({FILTERS[n]}) AS {n}" for n in ('ok', 'ocr', 'error', 'pending', 'unsupported'))}
FROM files""",
    "ocr_pending_count": f"""
{WF} SELECT count(*) AS files FROM files WHERE extension IN {OCR_EXT} AND {FILTERS['ocr']}""",
    "analysis_counters": f"""
{WF} SELECT count(*) FILTER (length(coalesce(content, '')) > 0) AS analysed, count(*) AS total FROM files""",
    "status_labels": f"""
{WF} SELECT id, CASE coalesce(extraction_status, 'pending') WHEN 'ok' THEN 'OK' WHEN 'ocr_pending' THEN 'OCR ожидает'
  WHEN 'ocr_processing' THEN 'OCR выполняется' WHEN 'error' THEN 'Ошибка' WHEN 'pending' THEN 'Ожидает'
  WHEN 'processing' THEN 'Обрабатывается' WHEN 'unsupported' THEN 'Неподдерживаемый' ELSE extraction_status END AS status_label,
  CASE WHEN is_cloud <> 0 THEN '☁ Облако' ELSE '💾 Локальный' END AS storage_label FROM files""",
    "status_note": f"""
{WF} SELECT least(count(*), 100) AS shown, count(*) >= 100 AS limit_reached FROM files""",
    "ocr_progress": f"""
{WF} SELECT id, CASE WHEN ocr_total_pages > 0 THEN ocr_page || '/' || ocr_total_pages ELSE '' END AS pages,
  printf('%.1f', CASE WHEN ocr_total_pages > 0 THEN ocr_page * 100.0::DOUBLE / ocr_total_pages ELSE 0.0::DOUBLE END) AS page_percent,
  printf('%.1f', CASE WHEN ocr_total_pages > 0 THEN ocr_page * 100.0::DOUBLE / ocr_total_pages ELSE 100.0::DOUBLE END) AS work_percent
FROM files""",
    "lookup_by_id": f"{WF} SELECT id, filepath, CAST(is_cloud AS INT) AS is_cloud, content FROM files WHERE id IN (12, 150, 777)",
}

_DUP = f"""
WITH dup AS ({O.DUP_FILES}), keyed AS (
  SELECT id, filename, filepath, {O.strip('lower(filename)')} AS name_key, is_cloud, content FROM dup),
named AS (
  SELECT * FROM keyed WHERE name_key <> '' QUALIFY count(*) OVER (PARTITION BY name_key) >= 2),
hashed AS (SELECT *, sha256(content) AS hash FROM named WHERE is_cloud = 0 AND content IS NOT NULL),
members AS (
  SELECT *, count(*) OVER (PARTITION BY name_key, hash) AS copies,
    row_number() OVER (PARTITION BY name_key, hash ORDER BY filename, id) AS rn
  FROM hashed QUALIFY copies >= 2)
"""

DUPLICATES = {
    "content_hash": f"WITH dup AS ({O.DUP_FILES}) SELECT id, sha256(content) AS hash FROM dup",
    "duplicates": f"{_DUP} SELECT hash, id, filename, filepath, rn = 1 AS is_first FROM members",
    "duplicate_groups": f"""
{_DUP} SELECT name_key, hash, copies, id AS first_id FROM members WHERE rn = 1""",
    "duplicate_rows": f"""
{_DUP} SELECT hash, id, CASE WHEN rn = 1 THEN 'КЛОН ' ELSE '  → ' END || filename AS title, 'Клон' AS kind,
  '100%' AS similarity, 'Идентичное содержимое' AS reason, filepath FROM members""",
    "duplicate_summary": f"{_DUP} SELECT count(*) FILTER (rn = 1) AS groups, count(*) AS files FROM members",
}

_CLASSIFIED = f"""
{WF}, scan AS ({O.SCAN}),
facts AS (
  SELECT *, length(coalesce(content, '')) AS content_chars, length(trim(coalesce(content, ''))) AS trimmed_chars,
    length({O.strip("coalesce(content, '')")}) AS stripped_chars FROM files),
pairs AS (
  SELECT coalesce(o.filepath, n.filepath) AS filepath, o.filepath IS NOT NULL AS in_old, n.filepath IS NOT NULL AS in_new,
    o.id, o.filename AS o_filename, o.extension AS o_extension, o.size AS o_size, o.modified AS o_modified,
    o.is_cloud AS o_cloud, o.extraction_status AS o_status, o.extraction_error AS o_error, o.ocr_page AS o_page,
    o.ocr_total_pages AS o_pages, o.file_hash, o.ocr_updated AS o_updated, o.content_chars, o.trimmed_chars, o.stripped_chars, o.content,
    n.filename AS n_filename, n.extension AS n_extension, n.size AS n_size, n.modified AS n_modified,
    coalesce(o.is_cloud, 0) <> 0 OR coalesce(n.is_cloud, 0) <> 0 AS cloud,
    o.size IS DISTINCT FROM n.size AS resized,
    o.size IS DISTINCT FROM n.size OR o.modified IS DISTINCT FROM n.modified AS touched,
    coalesce(lower(n.extension), '') IN {EXTRACTABLE} AS can
  FROM facts o FULL OUTER JOIN scan n ON o.filepath = n.filepath),
acted AS (
  SELECT *, CASE WHEN NOT in_new AND (filepath = '/lib' OR starts_with(filepath, '/lib/')) THEN 'missing'
      WHEN NOT in_new THEN 'kept' WHEN NOT in_old THEN 'new'
      WHEN o_status = 'error' AND NOT resized THEN 'error_locked'
      WHEN touched THEN 'changed' ELSE 'unchanged' END AS sync_action,
    CASE WHEN can THEN o_status WHEN stripped_chars >= 10 THEN 'ok' ELSE 'unsupported' END AS standing
  FROM pairs),
classified AS (
  SELECT *, in_new AND can AS extractable,
    sync_action = 'error_locked' AND (touched OR (coalesce(o_cloud, 0) <> 0) <> cloud) AS refresh,
    CASE WHEN sync_action IN ('new', 'changed') THEN can
         WHEN sync_action = 'unchanged' THEN can AND NOT coalesce(
           standing IN ('ocr_pending', 'ocr_processing', 'error') OR (standing = 'ok' AND stripped_chars >= 10), FALSE)
         ELSE FALSE END AS should_extract
  FROM acted)"""

_STATE = f"""{_CLASSIFIED},
flags AS (
  SELECT *, sync_action IN ('new', 'changed') AS fresh,
    coalesce(sync_action = 'unchanged' AND NOT extractable AND trimmed_chars < 10, FALSE) AS no_text
  FROM classified WHERE sync_action <> 'missing'),
state AS (
  SELECT CASE WHEN sync_action = 'new' THEN (SELECT max(id) FROM files)
              + row_number() OVER (PARTITION BY sync_action ORDER BY filepath) ELSE id END AS id,
    CASE WHEN fresh OR refresh THEN n_filename ELSE o_filename END AS filename, filepath,
    CASE WHEN fresh OR refresh THEN n_extension ELSE o_extension END AS extension,
    CASE WHEN fresh OR refresh THEN n_size ELSE o_size END AS size,
    CASE WHEN fresh OR refresh THEN n_modified ELSE o_modified END AS modified,
    CAST(CASE WHEN sync_action = 'kept' THEN o_cloud ELSE CAST(cloud AS INT) END AS INT) AS is_cloud,
    CASE WHEN fresh THEN CASE WHEN extractable THEN 'pending' ELSE 'unsupported' END
         WHEN no_text THEN 'unsupported' ELSE o_status END AS extraction_status,
    CASE WHEN fresh OR no_text THEN NULL ELSE o_error END AS extraction_error,
    CAST(CASE WHEN fresh THEN 0 ELSE o_page END AS INT) AS ocr_page,
    CAST(CASE WHEN fresh THEN 0 ELSE o_pages END AS INT) AS ocr_total_pages,
    file_hash, CASE WHEN NOT fresh THEN o_updated END AS ocr_updated,
    CAST(CASE WHEN fresh THEN 0 ELSE content_chars END AS INT) AS content_chars,
    CAST(CASE WHEN fresh THEN 0 ELSE trimmed_chars END AS INT) AS trimmed_chars,
    CAST(CASE WHEN fresh THEN 0 ELSE stripped_chars END AS INT) AS stripped_chars,
    CASE WHEN fresh THEN NULL ELSE content END AS content,
    sync_action, should_extract
  FROM flags)"""

_RESULTS = f"""
results AS (SELECT filepath,
       CASE size % 7 WHEN 0 THEN '   short ' WHEN 1 THEN NULL ELSE ' text read from ' || filename END AS text,
       CASE WHEN size % 11 < 3 THEN 'cannot open ' || filename END AS failure,
       CASE size % 11 WHEN 0 THEN 'hydrate' WHEN 1 THEN 'stopped' WHEN 2 THEN 'extraction' END AS failure_kind,
       extension = '.pdf' AND size % 3 = 0 AS ocr_required,
       CASE WHEN size % 2 = 0 THEN 'preview of ' || filename ELSE '  x  ' END AS preview,
       CAST(size % 9 AS INT) AS total_pages FROM scan),
judged AS (
  SELECT s.*, r.text, r.failure, r.preview, r.total_pages,
    length({O.strip("coalesce(r.text, '')")}) AS text_chars,
    CASE WHEN NOT should_extract THEN 'none'
         WHEN extension IN {IMAGES} THEN 'image_queued'
         WHEN failure_kind = 'hydrate' THEN 'hydrate_error' WHEN failure_kind = 'stopped' THEN 'stopped'
         WHEN coalesce(ocr_required, FALSE) THEN 'ocr_queued'
         WHEN failure_kind = 'extraction' THEN 'extraction_error'
         WHEN text_chars < 10 THEN 'too_little' ELSE 'ok' END AS outcome
  FROM state s LEFT JOIN results r ON r.filepath = s.filepath),
texts AS (
  SELECT *, CASE WHEN outcome = 'ok' THEN coalesce(text, '')
      WHEN outcome = 'ocr_queued' AND length({O.strip('preview')}) >= 10 THEN preview END AS new_content,
    outcome IN ('ok', 'image_queued', 'ocr_queued') AS success
  FROM judged),
outcomes AS (
  SELECT id, filename, filepath, extension, size, modified, is_cloud,
    CASE outcome WHEN 'none' THEN extraction_status WHEN 'image_queued' THEN 'ocr_pending' WHEN 'ocr_queued' THEN 'ocr_pending'
      WHEN 'stopped' THEN 'pending' WHEN 'ok' THEN 'ok' ELSE 'error' END AS extraction_status,
    CASE outcome WHEN 'none' THEN extraction_error WHEN 'hydrate_error' THEN left('Hydrate error: ' || failure, 2000)
      WHEN 'extraction_error' THEN left('Extraction error: ' || failure, 2000)
      WHEN 'too_little' THEN 'Извлечено слишком мало текста: ' || text_chars || ' символов' END AS extraction_error,
    CASE WHEN success THEN 0 ELSE ocr_page END AS ocr_page,
    CASE WHEN outcome = 'ocr_queued' THEN total_pages WHEN success THEN 0 ELSE ocr_total_pages END AS ocr_total_pages,
    file_hash, CASE WHEN NOT success THEN ocr_updated END AS ocr_updated,
    CAST(CASE WHEN success THEN length(coalesce(new_content, '')) ELSE content_chars END AS INT) AS content_chars,
    CAST(CASE WHEN success THEN length(trim(coalesce(new_content, ''))) ELSE trimmed_chars END AS INT) AS trimmed_chars,
    CAST(CASE WHEN success THEN length({O.strip("coalesce(new_content, '')")}) ELSE stripped_chars END AS INT) AS stripped_chars,
    sync_action, should_extract, outcome, success, new_content,
    CASE WHEN success THEN new_content ELSE content END AS content
  FROM texts)"""

SYNC = {
    "pdf_text_layer": f"""
{WF}, layers AS (
  SELECT filepath, content AS text FROM files WHERE extension = '.pdf'),
judged AS (SELECT *, length({O.strip("coalesce(text, '')")}) >= 80 AS enough FROM layers)
SELECT filepath, CASE WHEN enough THEN text END AS text, NOT enough AS ocr_required,
  CASE WHEN NOT enough THEN coalesce(text, '') END AS preview, 4 AS total_pages FROM judged""",
    "sync_classify": f"""
{_CLASSIFIED} SELECT filepath, sync_action, cloud, extractable, refresh, should_extract FROM classified""",
    "sync_apply": f"{_STATE} SELECT * EXCLUDE (content) FROM state",
    "sync_missing": f"""
{WF}, scan AS ({O.SCAN})
SELECT id, filepath FROM files f WHERE (filepath = '/lib' OR starts_with(filepath, '/lib/'))
  AND NOT EXISTS (SELECT 1 FROM scan s WHERE s.filepath = f.filepath)""",
    "sync_missing_unread": f"""
{WF}, scan AS ({O.SCAN}), unread AS ({O.UNREAD})
SELECT id, filepath FROM files f WHERE (filepath = '/lib' OR starts_with(filepath, '/lib/'))
  AND NOT EXISTS (SELECT 1 FROM scan s WHERE s.filepath = f.filepath)
  AND NOT EXISTS (SELECT 1 FROM unread u WHERE starts_with(f.filepath, u.path || '/'))""",
    "sync_apply_unread": _STATE.replace(
        "THEN 'missing'\n", "AND NOT EXISTS (SELECT 1 FROM unread u WHERE starts_with(filepath, u.path || '/')) THEN 'missing'\n"
    ).replace(f"scan AS ({O.SCAN}),", f"scan AS ({O.SCAN}), unread AS ({O.UNREAD}),") + " SELECT * EXCLUDE (content) FROM state",
    "metadata_flags": f"{O.METADATA} UNION ALL SELECT 'image_ocr_queue_v13', '1'",
    "sync_counters": f"""
{_STATE}, {_RESULTS}
SELECT count(*) FILTER (sync_action = 'new') AS added,
  count(*) FILTER (sync_action = 'changed') + count(*) FILTER (success AND sync_action <> 'new') AS updated,
  count(*) FILTER (sync_action <> 'kept' AND NOT should_extract) AS skipped,
  (SELECT count(*) FROM classified WHERE sync_action = 'missing') AS deleted,
  count(*) FILTER (sync_action <> 'kept') AS total FROM outcomes""",
    "extraction_outcome": f"{_STATE}, {_RESULTS} SELECT * EXCLUDE (content) FROM outcomes",
    "catalog_snapshot": f"""
{_STATE}, {_RESULTS} SELECT id, filename, filepath, extension, size, modified, is_cloud, extraction_status,
  extraction_error, ocr_page, ocr_total_pages, file_hash, ocr_updated, sha256(content) AS content_hash FROM outcomes""",
    "status_counts_deltas": f"""
{_STATE}, {_RESULTS} SELECT coalesce(nullif(extraction_status, ''), 'pending') AS status, count(*) AS files
FROM outcomes GROUP BY 1""",
    "database_summary_deltas": f"""
{_STATE}, {_RESULTS} SELECT count(*) AS total,
  {', '.join(f"count(*) FILTER ({FILTERS[n]}) AS {n}" for n in ('ok', 'ocr', 'error', 'pending', 'unsupported'))}
FROM outcomes""",
    "ocr_pending_count_deltas": f"""
{_STATE}, {_RESULTS} SELECT count(*) AS files FROM outcomes WHERE extension IN {OCR_EXT} AND {FILTERS['ocr']}""",
    "analysis_counters_deltas": f"""
{_STATE}, {_RESULTS} SELECT count(*) FILTER (length(coalesce(content, '')) > 0) AS analysed, count(*) AS total
FROM outcomes""",
    "needs_extraction": f"""
{WF} SELECT id, coalesce(lower(extension), '') IN {EXTRACTABLE} AND NOT coalesce(
  extraction_status IN ('ocr_pending', 'ocr_processing', 'error') OR (extraction_status = 'ok'
  AND length({O.strip("coalesce(content, '')")}) >= 10), FALSE) AS needs_extraction FROM files""",
    "catalog_repair": f"""
{WF}, old AS (SELECT id, filename, filepath, extension, size, modified,
       CASE WHEN id % 6 = 0 THEN ' brief   ' ELSE content END AS content,
       CASE WHEN extension = '.jpg' AND id % 4 = 0 THEN 'ok' ELSE extraction_status END AS extraction_status,
       extraction_error, CASE WHEN id % 3 = 0 THEN NULL ELSE ocr_page END AS ocr_page FROM files),
a AS (SELECT *, CASE WHEN extraction_status = 'ocr_processing' THEN 'ocr_pending' ELSE extraction_status END AS s1,
        length(trim(coalesce(content, ''))) < 10 AS short FROM old),
b AS (SELECT *, coalesce(extension IN {IMAGES} AND s1 IN ('pending', 'processing', 'error', 'ok') AND short, FALSE) AS requeue FROM a)
SELECT id, extension, 0 AS is_cloud,
  CASE WHEN requeue THEN 'ocr_pending' WHEN s1 = 'ok' AND short THEN 'pending' ELSE s1 END AS extraction_status,
  CASE WHEN requeue THEN NULL ELSE extraction_error END AS extraction_error,
  CASE WHEN requeue THEN 0 ELSE coalesce(ocr_page, 0) END AS ocr_page, 0 AS ocr_total_pages,
  CAST(NULL AS DOUBLE) AS ocr_updated, CAST(NULL AS VARCHAR) AS file_hash,
  CAST(length(coalesce(content, '')) AS INT) AS content_chars FROM b""",
}

_OCR = f"""
{WF}, pages AS ({O.OCR_PAGES}), waiting AS (
  SELECT * FROM files WHERE extension IN {OCR_EXT} AND {FILTERS['ocr']}),
added AS (
  SELECT p.file_id, string_agg(CASE WHEN p.text <> '' THEN chr(10) || p.text ELSE '' END, '' ORDER BY p.page) AS added_text,
    count(*) AS n, max(p.page) AS last_page, max(p.total_pages) AS total_pages
  FROM pages p JOIN waiting w ON w.id = p.file_id WHERE p.page > w.ocr_page GROUP BY p.file_id),
merged AS (
  SELECT id, filename, CASE WHEN n > 0 THEN coalesce(content, '') || added_text ELSE content END AS content,
    coalesce(last_page, ocr_page) AS ocr_page, coalesce(total_pages, ocr_total_pages) AS ocr_total_pages,
    CASE WHEN n > 0 THEN 'ocr_processing' ELSE extraction_status END AS extraction_status,
    CASE WHEN n > 0 THEN NULL ELSE extraction_error END AS extraction_error,
    CASE WHEN n > 0 THEN 1800000000.0::DOUBLE ELSE ocr_updated END AS ocr_updated,
    CAST(coalesce(n, 0) AS INT) AS added_pages
  FROM waiting LEFT JOIN added ON id = file_id),
finished AS (
  SELECT * REPLACE (
    CASE WHEN complete AND enough THEN 'ok' WHEN complete THEN 'error' ELSE extraction_status END AS extraction_status,
    CASE WHEN complete AND NOT enough THEN 'OCR не извлёк достаточно текста' WHEN complete THEN NULL
         ELSE extraction_error END AS extraction_error,
    CASE WHEN complete THEN 1800000000.0::DOUBLE ELSE ocr_updated END AS ocr_updated)
  FROM (SELECT *, ocr_total_pages > 0 AND ocr_page >= ocr_total_pages AS complete,
               length(trim(coalesce(content, ''))) >= 10 AS enough FROM merged) m)"""

SYNC |= {f"catalog_snapshot_{way}": SYNC["catalog_snapshot"] for way in ("deltas", "compacted")}

OCR = {
    "ocr_queue": f"""
{WF} SELECT id, filename, filepath, CAST(is_cloud AS INT) AS is_cloud, ocr_page, ocr_total_pages, extension,
  coalesce(size, 0) AS size, cost, row_number() OVER (ORDER BY cost, id) AS position
FROM (SELECT *, CASE WHEN extension = '.pdf' AND ocr_total_pages > 0 THEN CAST(ocr_total_pages AS BIGINT) * 500000
             ELSE coalesce(size, 0) END AS cost FROM files WHERE extension IN {OCR_EXT} AND {FILTERS['ocr']}) w""",
    "ocr_merge_pages": f"{_OCR} SELECT * FROM merged",
    "ocr_finish": f"{_OCR} SELECT * EXCLUDE (complete, enough) FROM finished",
    "ocr_run_counters": f"""
{_OCR} SELECT count(*) FILTER (extraction_status = 'ok') AS processed,
  count(*) FILTER (extraction_status = 'error') AS errors, count(*) AS total,
  count(*) FILTER (extraction_status IN ('ocr_pending', 'ocr_processing')) > 0 AS stopped FROM finished""",
    "ocr_stop": f"""
{WF} SELECT id, CASE WHEN extraction_status = 'ocr_processing' THEN 'ocr_pending' ELSE extraction_status END
  AS extraction_status FROM files""",
}

PARTS = [STATUS, DUPLICATES, SYNC, OCR]
