"""SQL for search, matching and explanation queries."""

from __future__ import annotations

from manualdex.oracle import common as O

Q = {
    "word": [("word", "гидроаккумулятор")],
    "ds350": [("tech", "ds350")],
    "ks": [("tech", "кс55724")],
    "onk": [("tech", "онк160с")],
    "ac35l": [("tech", "ac35l")],
    "pat_ac35l": [("word", "pat"), ("tech", "ac35l")],
    "e10": [("tech", "e10")],
    "dana": [("word", "dana"), ("word", "spicer")],
    "onk_e10": [("tech", "онк160с"), ("tech", "e10")],
    "pat_ds350_e15": [("word", "pat"), ("tech", "ds350"), ("tech", "e15")],
    "terex_onk": [("word", "terex"), ("tech", "онк160с")],
    "terex_ac35l": [("word", "terex"), ("tech", "ac35l")],
    "pat": [("word", "pat")],
}


def _search(name: str, limit: int = 200) -> str:
    return f"{O.WITH_TEXTS} {O.search_sql(Q[name], limit)}"


def _ids(condition: str) -> str:
    return f"{O.WITH_TEXTS} SELECT id FROM files WHERE {condition}"


def _coarse_code(head: str) -> str:
    return (
        "("
        + " OR ".join(
            f"contains({O.fold(f'''lower(coalesce({f}, ''))''')}, {O.fold(O.q(head))})"
            for f in ("filename", "filepath", "content")
        )
        + ")"
    )


def _coarse_word(word: str) -> str:
    return (
        "("
        + " OR ".join(
            f"contains(lower(coalesce({f}, '')), {O.q(word)})"
            for f in ("filename", "filepath", "content")
        )
        + ")"
    )


TEXT_EXT = "('.pdf', '.doc', '.docx', '.xls', '.xlsx', '.odt', '.ods', '.txt', '.csv', '.json')"


def _explain() -> str:
    reqs = [("tech", "онк160с"), ("tech", "e10")]
    arms = " UNION ALL ".join(
        f"""
SELECT position, id, {i + 1} AS requirement_no, {O.q(k)} AS kind, {O.q(v)} AS value,
       {O.hit('filename', k, v)} AS name_hit, {O.hit('filepath', k, v)} AS path_hit,
       {O.hit('content', k, v)} AS content_hit,
       CAST(least({O.count('content', k, v)}, 3) AS INT) AS context_count,
       CASE WHEN {O.hit('content', k, v)} THEN
         {O.excerpt("coalesce(content, '')", O.position('content', k, v), O.match_length('content', k, v), 140, False)}
       ELSE '' END AS first_context
FROM picked"""
        for i, (k, v) in enumerate(reqs)
    )
    return f"""
{O.WITH_TEXTS}, picked AS (
  SELECT *, CAST(row_number() OVER (
    ORDER BY CASE WHEN lower(filepath) LIKE '%онк%160%' THEN 0 ELSE 1 END, filename, id) AS INT) AS position
  FROM files
  WHERE (contains(lower(filename), '160') OR contains(lower(filepath), '160'))
    AND lower(coalesce(extension, '')) IN {TEXT_EXT}
    AND length(trim(coalesce(content, ''))) > 0
  QUALIFY position <= 40)
{arms}
"""


_e10, _onk = ("tech", "e10"), ("tech", "онк160с")
_text_docs = f"""
lower(coalesce(extension, '')) IN {TEXT_EXT} AND length(coalesce(content, '')) > 0
AND {O.metadata(*_onk)}"""

SEARCH = {
    "search_word": _search("word"),
    "search_single_model": _search("ds350"),
    "search_split_code": _search("ks"),
    "search_lookalike": _search("onk"),
    "search_brand_model": _search("pat_ac35l"),
    "search_fault": _search("e10"),
    "search_multi": _search("dana"),
    "diagnostic_search": _search("onk_e10"),
    "diagnostic_search_three": _search("pat_ds350_e15"),
    "search_by_postings": _search("ds350"),
    "search_by_postings_multi": _search("pat_ds350_e15"),
    "search_request_limit": _search("ac35l", 50),
    "search_snippets": f"""
{O.WITH_TEXTS} SELECT id, {O.snippet(Q['terex_onk'])} AS snippet
FROM files WHERE {O.match(Q['terex_onk'])}""",
    "search_summary": f"""
{O.WITH_TEXTS} SELECT count(*) AS results, count(*) FILTER (is_cloud) AS cloud_results
FROM ({O.search_sql(Q['word'])}) r""",
    "single_model_search": _ids(O.match(Q["ac35l"])),
    "brand_model_search": _ids(O.match(Q["terex_onk"])),
    "match_all": _ids(O.all_match(Q["pat_ds350_e15"])),
    "word_match": _ids(O.all_match(Q["pat"])),
    "tech_match": _ids(O.all_match(Q["ac35l"])),
    "field_hits": f"""
{O.WITH_TEXTS} SELECT id, {O.hit('filename', *_onk)} AS name_hit,
  {O.hit('filepath', *_onk)} AS path_hit, {O.hit('content', *_onk)} AS content_hit FROM files""",
    "model_evidence": f"""
{O.WITH_TEXTS} SELECT id, CAST({O.position('content', 'tech', 'ac35l')} AS INT) AS first_position,
  CAST(least({O.count('content', 'tech', 'ac35l')}, 3) AS INT) AS mentions
FROM files WHERE {O.hit('content', 'tech', 'ac35l')}""",
    "relevance_score": f"""
{O.WITH_TEXTS} SELECT id, CAST({O.score(Q['terex_ac35l'])} AS INT) AS score FROM files""",
    "numeric_model_metadata": _ids(O.numeric("кс55724")),
    "candidate_prefilter": _ids(f"{_coarse_word('pat')} AND {_coarse_code('онк')}"),
    "substring_probe": f"""
{O.WITH_TEXTS} SELECT id, filename, extension, filepath, contains(lower(filename), '55724') AS name_hit,
  contains(lower(filepath), '55724') AS path_hit,
  contains(lower(coalesce(content, '')), '55724') AS content_hit,
  CASE WHEN contains(lower(coalesce(content, '')), '55724') THEN
    {O.excerpt("content", "(strpos(lower(content), '55724') - 1)", "5", 140, False)} ELSE '' END AS context
FROM files WHERE {_coarse_word('55724')} ORDER BY id LIMIT 100""",
    "substring_total": f"""
{O.WITH_TEXTS} SELECT count(*) AS total FROM files WHERE {_coarse_word('55724')}""",
    "substring_total_by_index": f"""
{O.WITH_TEXTS} SELECT count(*) AS total FROM files WHERE {_coarse_word('гидроаккум')}""",
    "substring_words_by_index": f"""
{O.WITH_TEXTS} SELECT count(*) AS total FROM files WHERE {_coarse_word('er the th')}""",
    "match_explain": _explain(),
    "variant_hits": f"""
{O.WITH_TEXTS} SELECT count(*) AS context_documents,
  count(*) FILTER ({O.hit('content', *_e10)}) AS latin_hits,
  count(*) FILTER ({O.hit('content', 'tech', 'е10')}) AS cyrillic_hits
FROM files WHERE {_text_docs}""",
    "variant_hits_multi": f"""
{O.WITH_TEXTS} SELECT count(*) AS context_documents,
  count(*) FILTER ({O.hit('content', *_e10)}) AS one,
  count(*) FILTER ({O.hit('content', *_e10)} AND {O.hit('content', 'word', 'terex')}) AS two,
  count(*) FILTER ({O.hit('content', *_e10)} AND {O.hit('content', 'word', 'nosuchword')}) AS none
FROM files WHERE {_text_docs}""",
    "variant_examples": f"""
{O.WITH_TEXTS} SELECT id, filename, filepath,
  {O.excerpt("content", O.position('content', *_e10), O.match_length('content', *_e10), 120, False)} AS excerpt
FROM files WHERE {_text_docs} AND {O.hit('content', *_e10)} ORDER BY id LIMIT 20""",
}

# Tokens, merged codes and requirements of the questions.
_token = r"[A-Za-zА-Яа-яЁё0-9._/+\\-]+"
_stop = (
    "('в', 'на', 'за', 'от', 'до', 'по', 'и', 'или', 'с', 'со', 'из', 'для', 'к', 'о', 'об', 'про', "
    "'при', 'год', 'года', 'in', 'on', 'at', 'by', 'of', 'for', 'to', 'from', 'and', 'or', 'with', 'year')"
)
_techpat = r"^[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё._/+\\-]*$"


def tech_test(expr: str) -> str:
    return (
        f"(regexp_matches({expr}, {O.q(_techpat)}) AND regexp_matches({expr}, '[A-Za-zА-Яа-яЁё]') "
        f"AND regexp_matches({expr}, '[0-9]'))"
    )


FAULT = "regexp_matches({}, '^[A-Za-zА-Яа-яЁё][0-9]{{1,4}}$')"


def compact(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^0-9a-zа-яё]+', '', 'g')"


def tokens_ctes(source: str, key: str, column: str) -> str:
    """``tok`` (raw tokens), ``walk`` (positions after merging), ``merged`` and ``reqs``."""
    return f"""
tok AS (
  SELECT {key} AS k, i AS pos, lower(t) AS token, {compact('t')} AS c
  FROM (SELECT {key}, unnest(regexp_extract_all({column}, {O.q(_token)})) AS t,
               generate_subscripts(regexp_extract_all({column}, {O.q(_token)}), 1) AS i
        FROM {source}) x),
offer AS (
  SELECT a.k, a.pos, a.token, a.c, b.c AS c2, d.c AS c3,
    coalesce(regexp_matches(a.c, '^[a-zа-яё]{{1,4}}$') AND a.c NOT IN {_stop}
      AND regexp_matches(b.c, '^[0-9]+[a-zа-яё]*$'), FALSE) AS joins,
    coalesce(regexp_matches(d.c, '^[a-zа-яё]{{1,2}}$'), FALSE) AS tail
  FROM tok a LEFT JOIN tok b ON b.k = a.k AND b.pos = a.pos + 1
             LEFT JOIN tok d ON d.k = a.k AND d.pos = a.pos + 2),
walk AS (
  SELECT k, pos, 1 AS n,
    CASE WHEN joins AND tail THEN c || c2 || c3 WHEN joins THEN c || c2 ELSE token END AS word,
    pos + CASE WHEN joins AND tail THEN 3 WHEN joins THEN 2 ELSE 1 END AS next
  FROM offer WHERE pos = 1
  UNION ALL
  SELECT o.k, o.pos, w.n + 1,
    CASE WHEN o.joins AND o.tail THEN o.c || o.c2 || o.c3 WHEN o.joins THEN o.c || o.c2 ELSE o.token END,
    o.pos + CASE WHEN o.joins AND o.tail THEN 3 WHEN o.joins THEN 2 ELSE 1 END
  FROM walk w JOIN offer o ON o.k = w.k AND o.pos = w.next),
reqs AS (
  SELECT k, n, word, CASE WHEN {tech_test('word')} THEN 'tech' ELSE 'word' END AS kind,
    CASE WHEN {tech_test('word')} THEN {compact('word')} ELSE word END AS value
  FROM walk)"""


WITH_Q = f"WITH RECURSIVE questions AS ({O.QUESTIONS}), {tokens_ctes('questions', 'question_id', 'question')}"

SEARCH["substring_by_index"] = SEARCH["substring_probe"]

TEXT = {
    "raw_tokens": f"""
WITH questions AS ({O.QUESTIONS})
SELECT question_id, array_to_string(list_transform(regexp_extract_all(question, {O.q(_token)}),
  lambda t: lower(t)), ' ') AS tokens FROM questions""",
    "compact_code": f"WITH questions AS ({O.QUESTIONS}) SELECT question_id, {compact('question')} AS compact FROM questions",
    "lookalike_fold": f"WITH questions AS ({O.QUESTIONS}) SELECT question_id, {O.fold('question')} AS folded FROM questions",
    "merge_codes": f"""
{WITH_Q} SELECT q.question_id, coalesce(string_agg(w.word, ' ' ORDER BY w.n), '') AS tokens
FROM questions q LEFT JOIN walk w ON w.k = q.question_id GROUP BY q.question_id""",
    "tech_tokens": f"""
{WITH_Q} SELECT k AS question_id, CAST(pos - 1 AS INT) AS pos, token, {FAULT.format('token')} AS is_fault
FROM tok WHERE {tech_test('token')}""",
    "query_requirements": f"""
{WITH_Q} SELECT k AS question_id, CAST(n - 1 AS INT) AS pos, kind, value FROM reqs""",
    "tech_groups": f"""
{WITH_Q} SELECT k AS question_id, CAST(n - 1 AS INT) AS pos, value,
  array_to_string(regexp_extract_all(value, '[a-zа-яё]+|[0-9]+'), '|') AS groups
FROM reqs WHERE kind = 'tech'""",
}
