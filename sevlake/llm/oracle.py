"""DuckDB SQL of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"\x20\x09-\x0D"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?(.*)$"

OP1 = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
         translate(coalesce(url, ''), chr(9) || chr(13) || chr(10), '   ') AS u
  FROM pages
), k AS (
  SELECT *, regexp_extract(u, '{_URL}', 1) AS host, max(page_id) OVER (PARTITION BY body) AS newest FROM p
), r AS (
  SELECT *, payload_bytes >= 1000 AND newest <> page_id AS again FROM k
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN newest END AS refers_to,
       CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',')
            || regexp_extract(u, '{_URL}', 2) || ')' || regexp_extract(u, '{_URL}', 3) ELSE u END AS key
FROM r
"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, regexp_extract_all(text, '{_WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos, words FROM t
), v AS (
  SELECT r, pos, word, lead(word) OVER (PARTITION BY r ORDER BY pos) AS next,
         CASE WHEN pos + 7 <= len(words) THEN words[pos:pos + 7] END AS win
  FROM w
), s AS (
  SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM v
), c AS (
  SELECT *, bool_or(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM s
), per_doc AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
         count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS with_letter,
         count(*) FILTER (regexp_matches(word, '\p{{Lu}}') AND NOT regexp_matches(word, '[\p{{Ll}}\p{{Lt}}]')) AS upper_words,
         count(*) FILTER (regexp_matches(word, '\p{{Ll}}') AND NOT regexp_matches(word, '[\p{{Lu}}\p{{Lt}}]')) AS lower_words,
         count(*) FILTER (word = next) AS stutters
  FROM c GROUP BY r
), counted AS (
  SELECT r, word, count(*) AS n, min(pos) AS first FROM c GROUP BY r, word
), top AS (
  SELECT r, n AS top_n, n * length(word) AS top_chars FROM counted
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY n * length(word) DESC, first) = 1
), l AS (
  SELECT r, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{_BLANK}]*$'))) AS ellipses,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[{_BLANK}]*[•‣*-]'))) AS bullets
  FROM t
), b AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, l.n_symbols, l.n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, ellipses, bullets, with_letter, upper_words, lower_words, stutters, top_n, top_chars
  FROM d JOIN l USING (r) LEFT JOIN per_doc USING (r) LEFT JOIN top USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
         OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
         OR 10 * n_symbols > n_words
         OR 2 * n_dup_lines > n_lines
         OR 10 * with_letter < 6 * n_words
         OR (2 * upper_words > n_words AND upper_words > lower_words)
         OR (top_n > 1 AND 10 * top_chars > 3 * word_chars)
         OR 5 * stutters > n_words
         OR 10 * ellipses > 3 * n_lines
         OR (n_lines > 1 AND 10 * bullets > 9 * n_lines)) AS kept
FROM f
"""

OP6 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), s AS (
  SELECT r, lo, md5(raw[lo:lo + 199]) AS win
  FROM (SELECT r, raw, unnest(range(1, octet_length(raw) - 198)) AS lo FROM d)
), again AS (
  SELECT r, lo FROM s QUALIFY count(*) OVER (PARTITION BY win) > 1
), run AS (
  SELECT r, lo, coalesce(lo > lag(lo) OVER (PARTITION BY r ORDER BY lo) + 200, true) AS starts FROM again
), numbered AS (
  SELECT r, lo, count(*) FILTER (starts) OVER (PARTITION BY r ORDER BY lo) AS span FROM run
), spans AS (
  SELECT r, span, min(lo) AS lo, max(lo) + 199 AS hi FROM numbered GROUP BY r, span
), per_doc AS (
  SELECT r, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his
  FROM spans GROUP BY r
), pieces AS (
  SELECT r, raw, unnest(list_prepend(1, list_transform(his, lambda x: x + 1))) AS a,
         unnest(list_append(list_transform(los, lambda x: x - 1), octet_length(raw))) AS b
  FROM d JOIN per_doc USING (r)
), kept AS (
  SELECT r, string_agg(CASE WHEN a <= b THEN hex(raw[a:b]) ELSE '' END, '' ORDER BY a) AS hexa FROM pieces GROUP BY r
)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN hexa IS NULL THEN raw ELSE unhex(hexa) END) AS kept_sha256
FROM d LEFT JOIN per_doc USING (r) LEFT JOIN kept USING (r)
"""

OP8 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), q AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER upto, 0) AS capped, coalesce(sum(weight) OVER upto, 0) AS used
  FROM w WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, arg_min((total - capped) / (weights - used), ratio) FILTER (ratio >= (total - capped) / (weights - used)) OVER () AS level
  FROM q
), t AS (
  SELECT source, source_size, coalesce(least(CASE WHEN ratio >= level THEN weight * level ELSE cap END, cap), cap) AS target FROM l
), r AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3) ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, draw, doc_id) - 1 AS k FROM d
)
SELECT n.doc_id, n.size, r.source_size, r.target,
       (n.size * least(floor(r.shift + (n.k + 1) * r.rate) - floor(r.shift + n.k * r.rate), 3))::BIGINT AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""

# crc32 of a decimal number, byte by byte over t, the table of the reflected polynomial
_CRC32 = """xor(4294967295, list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
         lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1])))"""

OP11 = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), digest) AS pos FROM turns
), convs AS (
  SELECT c, size, {_CRC32.format("c")} % 6 AS h FROM (SELECT c, count(*) AS size FROM turns GROUP BY c), crc_table
), plan AS (
  SELECT a.*, a.c - a.c % 100 AS base, least(a.h, coalesce(b.size, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100
), rebuilt AS (
  SELECT c, pos - h + taken AS d, role, text FROM ranked JOIN plan USING (c) WHERE pos > h
  UNION ALL
  SELECT plan.c, pos AS d, role, text FROM plan JOIN ranked ON ranked.c = base WHERE pos <= taken
), whole AS (
  SELECT c, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (d IS NOT NULL), []) AS seq
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), paths AS (
  SELECT c, d, len(seq) = d AS ends, seq[1:d] AS prefix, CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS chars
  FROM whole, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)
), named AS (
  SELECT *, min(c) OVER node AS conv_id, count(*) OVER node AS n_convs, bool_and(ends) OVER node AS leaf FROM paths WINDOW node AS (PARTITION BY prefix)
), summed AS (
  -- a node counts once below each of its ancestors: on the path of its least member
  SELECT *, lag(conv_id) OVER (PARTITION BY c ORDER BY d) AS parent,
         sum(CASE WHEN c = conv_id AND leaf THEN 1 ELSE 0 END) OVER down AS leaves,
         sum(CASE WHEN c = conv_id THEN (n_convs - 1) * chars ELSE 0 END) OVER down AS saved
  FROM named WINDOW down AS (PARTITION BY c ORDER BY d DESC ROWS UNBOUNDED PRECEDING)
), nodes AS (
  SELECT conv_id, d AS depth, max(parent) AS parent_conv_id, count(*) AS n_convs, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM summed GROUP BY conv_id, d
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes LEFT JOIN kids USING (conv_id, depth)
"""

OP12 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), f AS (
  SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), m AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), step AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS l, ascii(substr(filter_order, step, 1)) - 64 AS k,
         list_transform(range(step - 1), lambda i: ascii(substr(filter_order, i + 1, 1)) - 64) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), r AS (
  SELECT part, filter_order, step, l, n, good, toxic, fails[k] AS own,
         len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda z: z)) = 1 AS alone
  FROM m, step
), g AS (
  SELECT part, filter_order, step, l, sum(n) FILTER (NOT gone AND NOT own) AS kept, sum(n) FILTER (NOT gone AND own) AS removed,
         sum(n) FILTER (gone AND own) AS redundant, sum(n) FILTER (own AND alone) AS unique_fails,
         sum(good) FILTER (NOT gone AND own) AS good_lost, sum(toxic) FILTER (NOT gone AND own) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::BIGINT AS shapley
FROM g
"""

ORACLE = {
    "op1_warc_index": OP1, "op5_quality_cascade": OP5, "op6_suffix_dedup": OP6, "op8_mix_sources": OP8, "op11_prefix_trie": OP11,
    "op12_filter_audit": OP12,
}
