"""SQL that gives the rows of the registered queries by plain means: all strings, all pairs, all variants.

Recursive terms follow links from each row to all it reaches, so they are for small tables alone.
"""

from __future__ import annotations

_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

LINE_DEDUP = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
lines AS MATERIALIZED (
  SELECT *, {_WORDS.format(text="line")} AS words, row_number() OVER (ORDER BY doc_id, line_no) AS place
  FROM split),
firsts AS MATERIALIZED (
  SELECT array_to_string(words, ' ') AS body, any_value(words) AS words, len(any_value(words)) AS n, min(place) AS place
  FROM lines WHERE len(words) > 0 GROUP BY array_to_string(words, ' ')),
shorter AS MATERIALIZED (
  SELECT body, n, place, unnest(range(1, n + 1)) AS gap,
         unnest(list_transform(range(1, n + 1), lambda i: md5(array_to_string(words[1:i - 1] || words[i + 1:], ' ')))) AS rest
  FROM firsts WHERE n > 1),
replaced AS (
  SELECT body FROM (SELECT body, place > min(place) OVER (PARTITION BY n, gap, rest) AS later FROM shorter) WHERE later),
near AS (
  SELECT body FROM replaced
  UNION SELECT CASE WHEN f.place < s.place THEN s.body ELSE f.body END FROM shorter s JOIN firsts f ON s.rest = md5(f.body)),
judged AS (
  SELECT l.*, f.body IS NOT NULL AND (l.place > f.place OR near.body IS NOT NULL) AS gone
  FROM lines l
  LEFT JOIN firsts f ON len(l.words) > 0 AND array_to_string(l.words, ' ') = f.body
  LEFT JOIN near ON near.body = f.body),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS kept_text
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept_text) AS n_chars_kept, sha256(kept_text) AS kept_sha256
FROM kept
"""

SUFFIX_DEDUP = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS MATERIALIZED (
  SELECT doc_id, unnest(range(0, n - 199)) AS pos,
         unnest(list_transform(range(0, n - 199), lambda i: md5(b[i + 1:i + 200]))) AS string
  FROM texts),
starts AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS earlier
  FROM strings WHERE string IN (SELECT string FROM strings GROUP BY string HAVING count(*) > 1)),
runs AS (
  SELECT doc_id, pos, count(*) FILTER (earlier IS NULL OR pos > earlier + 200) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM starts),
spans AS (SELECT doc_id, min(pos) AS lo, max(pos) + 200 AS hi FROM runs GROUP BY doc_id, run),
cuts AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM spans),
heads AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
         string_agg(hex(b[since + 1:lo]), '' ORDER BY lo) AS head
  FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1:n]))) AS kept_sha256
FROM texts LEFT JOIN heads USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
largest AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS most FROM usable),
small AS (SELECT vec_id, list_transform(v, lambda x: x / most) AS v FROM largest),
scaled AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM small),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM scaled x JOIN scaled y
  ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.95),
reached AS (
  SELECT a, a AS b FROM links
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings e LEFT JOIN components c ON e.vec_id = c.a LEFT JOIN degrees d ON e.vec_id = d.a
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="text")} AS words FROM documents),
split AS (SELECT doc_id, len(words) AS n_words, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM texts),
runs AS (
  SELECT doc_id, n_words, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w) AS shingle
  FROM split WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE i = 1 OR i <= n_words - 3),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
postings AS MATERIALIZED (SELECT doc_id, n, shingle FROM shingles JOIN sizes USING (doc_id)),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM postings x JOIN postings y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached AS (
  SELECT a, a AS b FROM links
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id LEFT JOIN components c ON t.doc_id = c.a
"""

_PIECES = rf"string_split_regex({_LOWER.format(text='text')}, '[.,;:!?\x0A-\x0D]')"

COLLOCATIONS = rf"""
WITH pieces AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents)),
words AS (SELECT lang, piece_no, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM pieces),
runs AS MATERIALIZED (
  SELECT lang, word, lead(word) OVER run AS word2, lead(word, 2) OVER run AS word3 FROM words WINDOW run AS (PARTITION BY piece_no ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
grams AS (
  SELECT lang, 1 AS size, word AS phrase FROM runs
  UNION ALL SELECT lang, 2, word || ' ' || word2 FROM runs WHERE word2 IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || word2 || ' ' || word3 FROM runs WHERE word3 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.f AS a, h.f AS l, t.f AS r, k.k,
         (1000000::HUGEINT * c.f * c.f) // (h.f::HUGEINT * t.f) AS score
  FROM counts c JOIN (VALUES (1), (2)) k(k) ON k.k < c.size
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(string_split(c.phrase, ' ')[1:k.k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(string_split(c.phrase, ' ')[k.k + 1:], ' ')
  WHERE c.size > 1),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase FROM counts WHERE size = 3
    UNION ALL SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM counts WHERE size = 3)
  GROUP BY lang, phrase),
free AS (
  SELECT lowest.* FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.phrase = lowest.phrase
  WHERE held.longer IS NULL OR 100 * held.longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

FILL_IN_MIDDLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM texts),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
