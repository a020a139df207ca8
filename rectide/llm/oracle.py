"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from rectide.llm.license_scan import TEMPLATES

#: Words of the contracts: runs without white space, and lower-cased alphanumeric runs.
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alnum_words(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, '{_ALNUM}')"


def _bigrams(text: str) -> str:
    return f"list_distinct(list_transform(range(1, len({text})), lambda i: {text}[i] || ' ' || {text}[i + 1]))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NOTICES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in TEMPLATES)

LICENSE_SCAN = f"""
WITH notice AS (
  SELECT name, {_bigrams('w')} AS g
  FROM (SELECT name, {_alnum_words('text')} AS w FROM (VALUES {_NOTICES}) AS v(name, text))
),
template AS (
  SELECT name, g, ceil(len(g) * 0.8 / 1.2 - 1e-9) AS low, floor(len(g) * 1.2 / 0.8 + 1e-9) AS high
  FROM notice WHERE len(g) > 0
),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
unit AS (SELECT r, doc_id, unnest(list_append(string_split(text, chr(10)), text)) AS u FROM doc),
numbered AS (SELECT row_number() OVER () AS k, r, {_alnum_words('u')} AS w FROM unit),
scored AS (
  SELECT k, r, name, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice
  FROM (SELECT k, r, {_bigrams('w')} AS g FROM numbered) s
  JOIN template t ON len(s.g) BETWEEN t.low AND t.high
),
best AS (
  SELECT r, name, dice FROM scored
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, name DESC) = 1
),
found AS (
  SELECT r, count(*) AS n_candidates, count(*) FILTER (dice >= 0.8) AS n_matches,
         string_agg(DISTINCT name, ',' ORDER BY name) FILTER (dice >= 0.8) AS licenses
  FROM best GROUP BY r
),
top AS (
  SELECT r, name, dice FROM best WHERE dice >= 0.8
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, name DESC) = 1
)
SELECT d.doc_id, len(string_split(d.text, chr(10))) + 1 AS n_units, coalesce(n_candidates, 0) AS n_candidates,
       coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses,
       top.name AS best_license, top.dice AS best_dice
FROM doc d LEFT JOIN found USING (r) LEFT JOIN top USING (r)
"""

DECONTAMINATE = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_alnum_words("coalesce(text, '')")} AS w FROM documents
),
item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_alnum_words("coalesce(text, '')")} AS w FROM benchmark
),
wanted AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
                               lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM item WHERE len(w) > 0
),
held AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM doc, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n
),
occurs AS (SELECT h.r, h.s, h.n, q.item FROM held h JOIN wanted q ON q.n = h.n AND q.win = h.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM occurs) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM occurs GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

HOST_RULES = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM doc),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE regexp_matches(line, '{_WORD}') GROUP BY r
),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM doc),
three AS (
  SELECT r, p, word, lead(word) OVER s AS b, lead(word, 2) OVER s AS c FROM word
  WINDOW s AS (PARTITION BY r ORDER BY p)
),
starts AS (
  SELECT r, p, c IS NOT NULL AND count(*) OVER (PARTITION BY r, word, b, c) > 1 AS twice FROM three
),
inside AS (
  SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS i FROM starts
),
repeats AS (SELECT r, count(*) FILTER (i) AS n_repeat_words FROM inside GROUP BY r),
counted AS (
  SELECT doc_id, source, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
host AS (
  SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM judged GROUP BY source
),
moments AS (
  SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v, avg(1 / docs) AS per_doc, avg(docs) AS mean_docs
  FROM host
),
prior AS (
  SELECT m, CASE WHEN v - m * (1 - m) * per_doc > 0
                 THEN greatest(m * (1 - m) / (v - m * (1 - m) * per_doc) - 1, 1e-6) ELSE mean_docs END AS strength
  FROM moments
)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       NOT j.base_failed AND (h.failed + p.m * p.strength) / (h.docs + p.strength)
         <= p.m + 3 * sqrt(p.m * (1 - p.m) / (p.strength + 1)) AS kept
FROM judged j JOIN host h ON j.source IS NOT DISTINCT FROM h.source CROSS JOIN prior p
"""

WINDOW_DEDUP = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word,
         unnest(list_transform(range(1, len(w) + 1),
                               lambda i: CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END)) AS win
  FROM doc
),
starts AS (
  SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS late
  FROM word
),
gone AS (
  SELECT doc_id, p, word,
         bool_or(late) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM starts
),
left_over AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (doc_id)
"""

#: CRC-32 of the id as text, bit by bit: eight steps for each byte.
_CRC = """
xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)),
    lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0::BIGINT END)),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)))
"""

BACKOFF_LM = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out,
         list_append(regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}'), '') AS w
  FROM documents
),
token AS (
  SELECT r, held_out, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS token, unnest(list_prepend(' ', w[:-2])) AS before
  FROM doc
),
known AS (SELECT token, count(*) AS c FROM token WHERE NOT held_out GROUP BY token),
arc AS (SELECT before, token, count(*) AS a FROM token WHERE NOT held_out GROUP BY before, token),
state AS (SELECT before, sum(a) AS n, count(*) AS t FROM arc GROUP BY before),
corpus AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS vocabulary FROM known),
step AS (
  SELECT x.r, x.p, c, coalesce(a, 0) AS a, n, t, total, (coalesce(c, 0) + 1) / (total + vocabulary + 1) AS root
  FROM token x LEFT JOIN known USING (token) LEFT JOIN arc USING (before, token) LEFT JOIN state USING (before)
  CROSS JOIN corpus
),
scored AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, any_value(total) AS train_tokens,
         sum(log10(root) ORDER BY p) AS base_score,
         sum(log10(CASE WHEN n IS NULL THEN root ELSE (a + t * root) / (n + t) END) ORDER BY p) AS score
  FROM step GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM doc JOIN scored USING (r)
"""

COLLOCATIONS = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL
),
spoken AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM spoken GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken),
gram AS (
  SELECT lang, g, len(g) AS size, count(*) AS f
  FROM (SELECT lang, w[i:i + s - 1] AS g FROM placed, range(1, 6) AS t(s) WHERE i + s - 1 <= len(w))
  GROUP BY lang, g HAVING count(*) >= 100
),
cut AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM gram WHERE size > 1) c
  JOIN gram l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN gram r ON r.lang = c.lang AND r.g = c.g[k + 1:]
  JOIN total t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, f, unnest([g[:size - 1], g[2:]]) AS g FROM gram WHERE size > 2
),
kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM inner_part i WHERE i.lang = x.lang AND i.g = x.g AND 100 * i.f >= 100 * x.a
  )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

LLM_ORACLE: dict[str, str] = {
    "op1_license_scan": LICENSE_SCAN,
    "op3_decontaminate": DECONTAMINATE,
    "op4_host_rules": HOST_RULES,
    "op5_window_dedup": WINDOW_DEDUP,
    "op10_backoff_lm": BACKOFF_LM,
    "op12_collocations": COLLOCATIONS,
}
