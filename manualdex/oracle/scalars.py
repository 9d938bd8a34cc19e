"""SQL for scalar functions, schedules, manifests and responses."""

from __future__ import annotations

from manualdex.oracle import common as O
from manualdex.oracle import questions as Qs
from manualdex.oracle.search import Q
from manualdex.sources import derived as D

_SCHED = f"WITH schedules AS ({O.SCHEDULES})"
_ATTR = D.ATTRIBUTES_SQL.format(files="files")
_MANIFESTS = D.MANIFESTS_SQL.format(documents="documents")
_SETTINGS = D.SETTINGS_SQL.format(events="events")

_CLOCKED = r"""
clocked AS (
  SELECT *, regexp_matches(time, '^\s*[+-]?[0-9]+\s*:\s*[+-]?[0-9]+\s*$') AS readable,
    CASE WHEN readable THEN least(greatest(CAST(split_part(time, ':', 1) AS INT), 0), 23) ELSE 18 END AS hh,
    CASE WHEN readable THEN least(greatest(CAST(split_part(time, ':', 2) AS INT), 0), 59) ELSE 0 END AS mm,
    CASE frequency WHEN 'weekly' THEN 7 WHEN 'interval' THEN greatest(1, interval_days) ELSE 1 END AS step,
    least(greatest(weekday, 0), 6) AS wd
  FROM schedules)"""


def _next(base: str, initial: str) -> str:
    day = f"CAST({base} AS DATE)"
    at = "+ to_hours(hh) + to_minutes(mm)"
    ahead = f"((wd - (isodow({base}) - 1) + 7) % 7)"
    week = f"(CAST({day} + CAST({ahead} AS INT) AS TIMESTAMP) {at})"
    soon = f"(CAST({day} AS TIMESTAMP) {at})"
    return f"""CASE WHEN frequency = 'weekly' THEN
      CASE WHEN {week} <= {base} OR (NOT {initial} AND {ahead} = 0) THEN {week} + INTERVAL 7 DAY ELSE {week} END
    WHEN {initial} AND {soon} > {base} THEN {soon}
    ELSE CAST({day} + CAST(step AS INT) AS TIMESTAMP) {at} END"""


_URL = f"replace(replace(url_encode({O.strip('question')}), '%20', '+'), '*', '%2A')"

SCALARS = {
    "extractable_flag": f"""
{O.WITH_FILES} SELECT id, coalesce(lower(extension), '') IN ('.pdf', '.doc', '.docx', '.xls', '.xlsx', '.odt', '.ods',
  '.txt', '.csv', '.json', '.jpg', '.jpeg', '.png', '.tif', '.tiff') AS extractable FROM files""",
    "cloud_flag": f"""
{O.WITH_FILES}, a AS ({_ATTR}) SELECT filepath, attributes <> 4294967295 AND (attributes & 524288) = 0
  AND (attributes & (1024 | 4096 | 262144 | 1048576 | 4194304)) <> 0 AS is_cloud FROM a""",
    "extract_route": f"""
{O.WITH_FILES} SELECT id, CASE WHEN lower(extension) = '.pdf' THEN 'pdf'
  WHEN lower(extension) IN ('.doc', '.docx', '.xls', '.xlsx', '.odt', '.ods') THEN 'office'
  WHEN lower(extension) IN ('.txt', '.csv', '.json') THEN 'text'
  WHEN lower(extension) IN ('.jpg', '.jpeg', '.png', '.tif', '.tiff') THEN 'image' ELSE 'none' END AS route FROM files""",
    "next_due": f"{_SCHED}, {_CLOCKED} SELECT id, {_next('base', 'initial')} AS next_due FROM clocked",
    "roll_forward_due": f"""
WITH RECURSIVE schedules AS ({O.SCHEDULES}), {_CLOCKED},
walk AS (
  SELECT id, frequency, wd, step, hh, mm, base + to_days(CAST(id % 700 AS INT)) + to_hours(CAST(id % 24 AS INT)) AS now,
    base AS due, 0 AS n FROM clocked
  UNION ALL
  SELECT id, frequency, wd, step, hh, mm, now, {_next('due', 'FALSE')}, n + 1 FROM walk WHERE due <= now)
SELECT id, arg_max(due, n) AS next_due FROM walk GROUP BY id""",
    "schedule_action": f"""
WITH s AS ({_SETTINGS}), p AS (
  SELECT *, coalesce(lower(trim(enabled)) IN ('1', 'true', 'yes', 'on'), FALSE) AS is_enabled,
    lower(trim(run_overdue)) IN ('1', 'true', 'yes', 'on') AS overdue, try_cast(trim(next_due) AS TIMESTAMP) AS due FROM s)
SELECT id, CASE WHEN NOT is_enabled THEN 'none' WHEN due IS NULL THEN 'reschedule' WHEN due > now THEN 'wait'
  WHEN startup AND NOT overdue THEN 'roll_forward' ELSE 'run' END AS action FROM p""",
    "lenient_casts": f"""
WITH s AS ({_SETTINGS})
SELECT id, coalesce(lower(trim(enabled)) IN ('1', 'true', 'yes', 'on'), FALSE) AS enabled_or_false,
  coalesce(lower(trim(enabled)) IN ('1', 'true', 'yes', 'on'), TRUE) AS enabled_or_true,
  try_cast(trim(next_due) AS TIMESTAMP) AS due,
  coalesce(strftime(try_cast(trim(next_due) AS TIMESTAMP), '%d.%m.%Y %H:%M'), '—') AS shown FROM s""",
    "web_search_url": f"""
WITH questions AS ({O.QUESTIONS}) SELECT question_id, CASE WHEN {O.strip('question')} = '' THEN ''
  ELSE 'https://www.google.com/search?q=' || {_URL} END AS url FROM questions""",
    "normalize_language": f"""
WITH s AS ({_SETTINGS}), c AS (SELECT id, replace(lower(trim(coalesce(language, ''))), '_', '-') AS code FROM s)
SELECT id, CASE WHEN code IN ('ru', 'uk', 'en') THEN code WHEN code LIKE 'uk%' OR code LIKE 'ua%' THEN 'uk'
  WHEN code LIKE 'en%' THEN 'en' ELSE 'ru' END AS language FROM c""",
    "validate_manifest": rf"""
WITH m AS ({_MANIFESTS}), t AS (
  SELECT id, json_valid(json) AND json_type(CASE WHEN json_valid(json) THEN json ELSE 'null' END) = 'OBJECT' AS is_object,
    CASE WHEN json_valid(json) THEN json ELSE 'null' END AS j FROM m),
f AS (
  SELECT id, is_object, json_extract_string(j, '$.format') AS format,
    json_extract_string(j, '$.database_filename') AS db,
    {{'k': json_type(j, '$.backup_version'), 'v': json_extract_string(j, '$.backup_version')}} AS bv,
    {{'k': json_type(j, '$.database_schema'), 'v': json_extract_string(j, '$.database_schema')}} AS ds FROM t),
n AS (
  SELECT *, list_transform([bv, ds], lambda x: CASE WHEN x.k IS NULL THEN 0
      WHEN x.k = 'BOOLEAN' THEN CASE WHEN x.v = 'true' THEN 1 ELSE 0 END
      WHEN x.k = 'VARCHAR' THEN CASE WHEN regexp_matches(trim(x.v), '^[+-]?[0-9]+$') THEN CAST(trim(x.v) AS BIGINT) END
      WHEN x.k IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(trunc(CAST(x.v AS DOUBLE)) AS BIGINT) END) AS nums FROM f),
r AS (
  SELECT id, CASE WHEN NOT is_object THEN 'Manifest is not an object'
    WHEN format IS DISTINCT FROM 'catalog-portable' THEN 'Unknown backup format'
    WHEN nums[1] IS NULL OR nums[2] IS NULL THEN 'Invalid backup version'
    WHEN nums[1] > 1 THEN 'Backup was created by a newer version'
    WHEN nums[2] < 13 THEN 'Database schema is too old for direct mobile import'
    WHEN coalesce(db, '') = '' THEN 'Database file is not declared' ELSE 'OK' END AS message FROM n)
SELECT id, message, message = 'OK' AS ok FROM r""",
    "manifest_json": f"""
WITH s AS ({_SETTINGS}), c AS (SELECT id, now, replace(lower(trim(coalesce(language, ''))), '_', '-') AS code FROM s),
l AS (SELECT id, now, CASE WHEN code IN ('ru', 'uk', 'en') THEN code WHEN code LIKE 'uk%' OR code LIKE 'ua%' THEN 'uk'
  WHEN code LIKE 'en%' THEN 'en' ELSE 'ru' END AS language FROM c)
SELECT id, CAST(to_json({{'format': 'catalog-portable', 'backup_version': 1, 'database_schema': CAST(id % 40 AS INT),
  'created_utc': strftime(now, '%Y-%m-%dT%H:%M:%S+00:00'), 'app_version': 'development', 'language': language,
  'current_root': '/lib', 'database_filename': 'catalog.db'}}) AS VARCHAR) AS manifest FROM l""",
    "search_response_json": f"""
{O.WITH_TEXTS}, r AS ({O.search_sql(Q['ac35l'], 50)})
SELECT CAST(to_json({{'query': 'ac 35 l', 'total': count(*), 'items': list({{'file_id': file_id, 'filename': filename,
  'extension': extension, 'snippet': snippet, 'filepath': filepath, 'is_cloud': is_cloud}} ORDER BY rank)}}) AS VARCHAR)
  AS response FROM r""",
    "ask_response_json": f"""
{Qs._SOURCES}, listed AS (
  SELECT query, list({{'source_id': 'S' || source_no, 'filename': filename, 'filepath': filepath, 'excerpt': context}}
    ORDER BY source_no) AS items FROM sources GROUP BY query)
SELECT question_id, CAST(to_json({{'answer': '', 'sources': coalesce(items, []), 'local_only': TRUE}}) AS VARCHAR) AS response
FROM planned p LEFT JOIN listed l ON l.query = p.search_query""",
}

PARTS = [SCALARS]
