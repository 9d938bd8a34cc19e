"""DuckDB SQL of the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH keyed AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM keyed
"""

#: Phrases of 2 and 3 words; support 10, 50 per cent covered, 2,000 a language.
COLLOCATIONS = f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, phrase, count(*) AS c FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                          lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
known AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE c >= 10),
cuts AS (
  SELECT lang, k, phrase, c AS a, w, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
  FROM known, (SELECT unnest([1, 2]) AS cut) WHERE k > cut),
scored AS (
  SELECT t.lang, t.phrase, t.a, h.c AS l, r.c AS r,
         ((1000000::HUGEINT * t.a * t.a) // (h.c::HUGEINT * r.c))::BIGINT AS score, cut
  FROM cuts t JOIN known h ON h.lang = t.lang AND h.phrase = t.head
              JOIN known r ON r.lang = t.lang AND r.phrase = t.rest
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(c) AS longer FROM (
    SELECT lang, c, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM known WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op9_exact_dedup": EXACT_DEDUP, "op12_collocations": COLLOCATIONS}
