"""SQL fragments for the DuckDB side of the checks.

RE2 has no look-around, so word edges are consumed characters, positions come from the
length of a leading group, and counting doubles every edge character first.
"""

from __future__ import annotations

import re

from manualdex.sources import derived as D

W = "0-9A-Za-zА-Яа-яЁё"
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SEP = rf"[{SPACE}._/+\\-]*"
CYR = "АВСЕНКМОРТХавсенкмортх"
LAT = "ABCEHKMOPTXabcehkmoptx"

FILES = D.FILES_SQL.format(documents="documents")
TEXTS = D.TEXTS_SQL.format(documents="documents")
SCAN = D.SCAN_SQL.format(files="files")
OCR_PAGES = D.OCR_PAGES_SQL.format(files="files")
UNREAD = D.UNREAD_SQL.format(documents="documents")
METADATA = D.METADATA_SQL.format(documents="documents")
DUP_FILES = D.DUP_FILES_SQL.format(documents="documents")
QUESTIONS = D.QUESTIONS_SQL.format(conversations="conversations")
ASKED = D.ASKED_SQL.format(conversations="conversations")
SCHEDULES = D.SCHEDULES_SQL.format(events="events")
WITH_FILES = f"WITH files AS ({FILES})"
WITH_TEXTS = f"WITH files AS ({TEXTS})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(expr: str) -> str:
    return f"translate({expr}, '{CYR}', '{LAT}')"


def strip(expr: str) -> str:
    b = f"[{SPACE}]"
    return f"regexp_replace({expr}, '^{b}+|{b}+$', '', 'g')"


def groups(value: str) -> list[str]:
    return re.findall("[a-zа-яё]+|[0-9]+", value)


def is_fault(kind: str, value: str) -> bool:
    return kind == "tech" and re.fullmatch("[a-zа-яё][0-9]{1,4}", value) is not None


def body(kind: str, value: str) -> str:
    if kind == "tech":
        table = str.maketrans(CYR, LAT)
        return SEP.join(g.translate(table) for g in groups(value))
    return re.sub(f"([^{W}])", r"\\\1", value)


def right(kind: str, value: str) -> str:
    if kind == "tech" and value[-1].isdigit() and not is_fault(kind, value):
        return "(?:$|[^0-9])"
    return f"(?:$|[^{W}])"


def subject(field: str, kind: str) -> str:
    base = f"coalesce({field}, '')"
    return fold(base) if kind == "tech" else base


def hit(field: str, kind: str, value: str) -> str:
    pattern = f"(?i)(?:^|[^{W}]){body(kind, value)}{right(kind, value)}"
    return f"regexp_matches({subject(field, kind)}, {q(pattern)})"


def _lead(kind: str, value: str) -> str:
    return f"(?is)^((?:.*?[^{W}])??)({body(kind, value)}){right(kind, value)}"


def position(field: str, kind: str, value: str) -> str:
    return f"length(regexp_extract({subject(field, kind)}, {q(_lead(kind, value))}, 1))"


def match_length(field: str, kind: str, value: str) -> str:
    return f"length(regexp_extract({subject(field, kind)}, {q(_lead(kind, value))}, 2))"


def count(field: str, kind: str, value: str) -> str:
    doubled = f"regexp_replace({subject(field, kind)}, '([^{W}])', '\\1\\1', 'g')"
    pattern = f"(?i)(?:^|[^{W}]){body(kind, value)}{right(kind, value)}"
    return f"len(regexp_extract_all({doubled}, {q(pattern)}))"


def any_field(kind: str, value: str) -> str:
    return "(" + " OR ".join(hit(f, kind, value) for f in ("filename", "filepath", "content")) + ")"


def metadata(kind: str, value: str) -> str:
    return f"({hit('filename', kind, value)} OR {hit('filepath', kind, value)})"


def numeric(value: str) -> str:
    tests = [
        f"regexp_matches(coalesce({f}, ''), {q(f'(?:^|[^0-9]){n}(?:$|[^0-9])')})"
        for n in re.findall("[0-9]+", value)
        if len(n) >= 3
        for f in ("filename", "filepath")
    ]
    return "(" + " OR ".join(tests) + ")" if tests else "FALSE"


def all_match(reqs) -> str:
    return " AND ".join(any_field(k, v) for k, v in reqs)


def context_rule(reqs) -> str:
    if len(reqs) >= 2 and is_fault(*reqs[-1]):
        return "(" + " OR ".join(metadata(k, v) for k, v in reqs[:-1]) + ")"
    return "TRUE"


def model_rule(reqs) -> str:
    models = [r for r in reqs if r[0] == "tech" and not is_fault(*r)]
    words = [r for r in reqs if r[0] == "word"]
    if len(reqs) == 1 and models:
        k, v = models[0]
        return (
            f"({metadata(k, v)} OR {numeric(v)} OR ({hit('content', k, v)} AND "
            f"{position('content', k, v)} <= 1200 AND {count('content', k, v)} >= 2))"
        )
    if len(reqs) == 2 and len(models) == 1 and len(words) == 1:
        k, v = models[0]
        return (
            f"({metadata(k, v)} OR ({hit('content', k, v)} AND "
            f"({position('content', k, v)} <= 8000 OR {count('content', k, v)} >= 3)))"
        )
    return "TRUE"


def match(reqs) -> str:
    return f"({all_match(reqs)} AND {context_rule(reqs)} AND {model_rule(reqs)})"


def score(reqs) -> str:
    return " + ".join(
        f"CASE WHEN {hit('filename', k, v)} THEN 120 WHEN {hit('filepath', k, v)} THEN 80 "
        f"WHEN {hit('content', k, v)} THEN 10 ELSE 0 END"
        for k, v in reqs
    )


def snippet_order(reqs):
    tail = [reqs[-1]] if is_fault(*reqs[-1]) else []
    rest = reqs[: len(reqs) - len(tail)]
    return tail + [r for r in rest if r[0] == "tech"] + [r for r in rest if r[0] == "word"]


def excerpt(text: str, pos: str, length: str, radius: int, dots: bool) -> str:
    start = f"greatest(0, {pos} - {radius})"
    end = f"least(length({text}), {pos} + {length} + {radius})"
    cut = f"translate(substring({text}, {start} + 1, {end} - {start}), chr(13) || chr(10), '  ')"
    if not dots:
        return cut
    return (
        f"CASE WHEN {start} > 0 THEN '...' ELSE '' END || {cut} || "
        f"CASE WHEN {end} < length({text}) THEN '...' ELSE '' END"
    )


def snippet(reqs, radius: int = 180) -> str:
    text = "coalesce(content, '')"
    arms = " ".join(
        f"WHEN {hit('content', k, v)} THEN "
        + excerpt(text, position("content", k, v), match_length("content", k, v), radius, True)
        for k, v in snippet_order(reqs)
    )
    return f"CASE {arms} ELSE '' END"


def search_sql(reqs, limit: int = 200, source: str = "files") -> str:
    """Ranked search results of a parsed query over ``source``."""
    return f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, lower(filename), file_id) AS INT) AS rank,
       file_id, filename, extension, filepath,
       CASE WHEN snippet = '' THEN 'Найдено в имени или пути файла' ELSE snippet END AS snippet,
       is_cloud, score
FROM (SELECT id AS file_id, filename, coalesce(extension, '') AS extension, filepath,
             {snippet(reqs)} AS snippet, coalesce(is_cloud, 0) <> 0 AS is_cloud,
             CAST({score(reqs)} AS INT) AS score
      FROM {source} WHERE {match(reqs)}) m
QUALIFY rank <= {limit}
"""
