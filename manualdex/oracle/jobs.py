"""SQL for file-reading and streaming jobs and listings."""

from __future__ import annotations

from manualdex.oracle import catalog as C

_LATIN = "".join(chr(i) for i in range(0x80, 0x100) if i != 0x98)
_CYRILLIC = bytes(i for i in range(0x80, 0x100) if i != 0x98).decode("cp1251")

FILES = {
    "scan_folder": """
SELECT lang, '.txt' AS extension, 0 AS is_cloud, TRUE AS extractable,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang""",
    "folder_text": "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "decode_text": rf"""
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 AND NOT regexp_matches(text, '[^\x00-\x{{ff}}]')
    AND regexp_matches(text, '[\x{{80}}-\x{{ff}}]')
  THEN translate(text, '{_LATIN}', '{_CYRILLIC}') ELSE text END AS text FROM documents""",
    "extract_office_text": r"""
SELECT '/lib/' || doc_id || '.docx' AS path,
  array_to_string(list_filter(string_split(text, chr(10)), lambda p: p <> ''), chr(10)) AS text FROM documents""",
}

STREAMS = {
    "stream_sync": C.SYNC["sync_apply"],
    "stream_ocr_pages": C.OCR["ocr_finish"],
    "stream_status_counts": C.STATUS["status_counts"],
}

PARTS = [FILES, STREAMS]
