"""DuckDB SQL that gives the same rows as the queries of operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, {FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL),
  iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM i WHERE len(w) > 0)),
  ns AS (SELECT DISTINCT n FROM iw),
  dw AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, ns WHERE len(w) >= n)),
  h AS (SELECT doc_id, n, j, item FROM dw JOIN iw USING (n, k)),
  hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY 1),
  hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

NGRAM_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS j FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = d.doc_id"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  v AS (SELECT doc_id, j, array_to_string(w[j:j + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS j FROM d WHERE len(w) >= 35)),
  g AS (SELECT DISTINCT doc_id, unnest(range(j, j + 35)) AS p FROM v WHERE k IN (SELECT k FROM v GROUP BY 1 HAVING count(*) > 1)),
  o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
  k AS (SELECT o.doc_id, string_agg(w[o.p], ' ' ORDER BY o.p) FILTER (g.p IS NULL) AS s, count(g.p) AS n_removed FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.p = o.p GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

QUOTED = "\\### Assistant: </turn> ok"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{QUOTED}'), (-7, 1, 'assistant', '{QUOTED}')),
  e AS (SELECT *, replace(replace(text, '\\', '\\b'), '<', '\\l') AS et, replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), chr(10), '\\n') AS er FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(6 + length(er) + 1 + length(et) + 8) AS BIGINT) AS formatted_chars FROM e GROUP BY 1"""

FILTER_AUDIT = f"""WITH g AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, {WORDS} AS w FROM documents),
  e AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS again FROM t),
  f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), regexp_matches(x, '[#$%&*|]'), again] AS fails FROM e LEFT JOIN g USING (doc_id)),
  c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
  s AS (SELECT filter_order, step, [CAST(ascii(filter_order[j]) - 64 AS INT) FOR j IN range(1, step)] AS earlier, CAST(ascii(filter_order[step]) - 64 AS INT) AS own FROM o, (SELECT unnest(range(1, 6)) AS step)),
  r AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, len([j FOR j IN earlier IF fails[j]]) > 0 AS gone, len([y FOR y IN fails IF y]) AS n_fails FROM c, s),
  q AS (SELECT part, filter_order, step, own, sum(CASE WHEN gone OR hit THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN hit AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
  SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q"""

PREFIX_TRIE = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
  z AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM n UNION ALL
    SELECT conv_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE crc END AS x FROM z WHERE i < 8 * length(s))),
  h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM n JOIN z USING (conv_id) WHERE i = 8 * length(s)),
  c AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS taken, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS length FROM h LEFT JOIN n b ON b.conv_id = h.base),
  r AS (SELECT c.conv_id, t.k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.k < c.taken UNION ALL SELECT c.conv_id, t.k - c.h + c.taken, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k >= c.h),
  p AS (SELECT conv_id, k + 1 AS depth, string_agg(sha256(length(role) || ':' || role || text), ' ') OVER (PARTITION BY conv_id ORDER BY k) AS key, octet_length(encode(text)) AS bytes FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
  v AS (SELECT depth, key, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, count(*) FILTER (depth = length) AS n_ends,
    coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = length), '') AS ends FROM p JOIN c USING (conv_id) GROUP BY 1, 2),
  a AS (SELECT p.depth, p.key, sum(CAST(v.n_ends = v.n_convs AS INT)) AS n_leaves, sum(v.saved) AS saved_tokens, count(*) FILTER (v.depth = p.depth + 1) AS n_children FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1, 2),
  u AS (SELECT v.conv_id, v.depth, q.key AS above FROM v JOIN p q ON q.conv_id = v.conv_id AND q.depth = v.depth - 1)
  SELECT v.conv_id, v.depth, w.conv_id AS parent_conv_id, v.n_convs, a.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
  FROM v JOIN a USING (depth, key) LEFT JOIN u ON u.conv_id = v.conv_id AND u.depth = v.depth LEFT JOIN v w ON w.depth = v.depth - 1 AND w.key = u.above"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
  d AS (SELECT page_id, octet_length(encode(x)) AS payload_bytes, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS keeper FROM p)
  SELECT page_id, payload_bytes, array_to_string([chr(CAST(CASE WHEN v < 26 THEN 65 + v ELSE 24 + v END AS INT)) FOR v IN [CAST('0x' || h[10 * (j // 8) + 1:10 * (j // 8) + 10] AS BIGINT) >> (35 - 5 * (j % 8)) & 31 FOR j IN range(32)]], '') AS payload_digest,
    CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to FROM d"""

ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op4_ngram_jaccard": NGRAM_JACCARD,
    "op6_substring_dedup": SUBSTRING,
    "op8_chat_format": CHAT,
    "op11_warc": WARC,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_prefix_trie": PREFIX_TRIE,
}
