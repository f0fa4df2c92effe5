"""DuckDB restatements of the queries of this folder, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), rowed AS (SELECT row_number() OVER () AS row_no, * FROM w),
spots AS (
  SELECT row_no, unnest(range(1, greatest(len(words) - 3, 1))) AS pos, words FROM rowed
), windows AS (SELECT row_no, pos, array_to_string(words[pos:pos + 4], ' ') AS body FROM spots),
twice AS (
  SELECT row_no, pos FROM (SELECT row_no, pos, count(*) OVER (PARTITION BY row_no, body) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_no, count(DISTINCT place) AS n FROM (SELECT row_no, unnest(range(pos, pos + 5)) AS place FROM twice) GROUP BY row_no
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM rowed LEFT JOIN covered USING (row_no)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR (2 * n_dup_lines > n_lines AND n_dup_lines >= 2) OR 10 * n_capitals > 4 * word_chars) AS kept
FROM m
"""

_MATCHES = r"""
{kind}_found AS (
  SELECT row_no, '{kind}' AS kind, {rank} AS rank, starts[k] AS start, starts[k] + length(values[k]) AS stop, values[k] AS value FROM (
    SELECT row_no, values, unnest(range(1, len(values) + 1)) AS k,
           list_transform(range(1, len(values) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT
             + coalesce(list_sum(list_transform(values[1:i - 1], lambda v: length(v))), 0)::BIGINT) AS starts
    FROM (SELECT row_no, regexp_extract_all(text, $q${pattern}$q$) AS values, string_split_regex(text, $q${pattern}$q$) AS gaps FROM d)
  )
)"""

_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_KINDS = (
    ("assign", 1, _ASSIGN), ("access", 2, "AKIA[A-Z0-9]{16,}"), ("hex", 3, "[0-9a-f]{24,}"), ("entropy", 4, "[A-Za-z0-9+/_=-]{20,}"),
)
_ALLOWED = (
    "^[A-Za-z+/_=-]+$|^[0-9+/_=-]+$|^[A-Za-z]+[0-9]{0,4}$|^([A-Z]?[a-z]+|[0-9]{1,4})([/_-]([A-Z]?[a-z]+|[0-9]{1,4}))+$"
)

ORACLES["op4_secret_scan"] = (
    "WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_MATCHES.format(kind=k, rank=r, pattern=p) for k, r, p in _KINDS)
    + rf""",
base AS (
  SELECT row_no, kind, rank, start, stop FROM assign_found
  WHERE length(regexp_extract(value, $q$(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$q$, 2)) >= 6
  UNION ALL SELECT row_no, kind, rank, start, stop FROM access_found
  UNION ALL SELECT row_no, kind, rank, start, stop FROM hex_found
), dense AS (
  SELECT *, list_max(list_transform(range(1, length(value) - 18),
           lambda i: list_aggregate(string_split(substring(value, i, 20), ''), 'entropy'))) AS bits,
         CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(value, '^[A-Za-z0-9]+$') THEN 3.7 ELSE 3.9 END AS least
  FROM entropy_found WHERE NOT regexp_matches(value, $q${_ALLOWED}$q$)
), added AS (
  SELECT row_no, kind, rank, start, stop FROM dense e WHERE bits >= least AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.row_no = e.row_no AND b.start <= e.start AND e.stop <= b.stop)
), every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM added),
listed AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (is_base) AS base_text,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM every GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (row_no)
"""
)

ORACLES["op8_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[pos:pos + 9], ' ') AS body
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT row_no, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS body
  FROM (SELECT row_no, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d, sizes WHERE len(words) >= size)
), hits AS (SELECT row_no, item_id, pos, s.size FROM spots s JOIN windows w ON s.body = w.body AND s.size = w.size),
counted AS (
  SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY row_no
), named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (row_no) LEFT JOIN named USING (row_no)
"""

ORACLES["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
           ELSE list_transform(range(1, greatest(len(words) - 1, 2)), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingles
  FROM d
), flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least ON least.a = s.doc_id
"""

# CRC-32 in bits: each byte enters at its first of eight steps.
ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), framed AS (
  SELECT row_no, doc_id, lang, coalesce(xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL, false) AS tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS after
  FROM d
), hashed AS (
  SELECT row_no, doc_id, lang, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
         CASE WHEN tampered THEN sha256(before || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || after) END AS changed
  FROM framed
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), low AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), up AS (
  SELECT row_no, lang, 0 AS level, pos, n, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT up.row_no, up.lang, up.level + 1, up.pos // 2, (up.n + 1) // 2,
         sha256(CASE WHEN up.pos % 2 = 0 THEN up.h || coalesce(low.h, '') ELSE low.h || up.h END), up.proof || coalesce(low.h, '')
  FROM up LEFT JOIN low ON low.lang IS NOT DISTINCT FROM up.lang AND low.level = up.level AND low.pos = xor(up.pos, 1::BIGINT)
  WHERE up.n > 1
), upper AS (
  SELECT up.row_no, 0 AS level, s.pos, s.n, up.h, up.proof FROM up JOIN subroots s ON s.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1
  UNION ALL
  SELECT u.row_no, u.level + 1, u.pos // 2, (u.n + 1) // 2,
         sha256(CASE WHEN u.pos % 2 = 0 THEN u.h || coalesce(high.h, '') ELSE high.h || u.h END), u.proof || coalesce(high.h, '')
  FROM upper u LEFT JOIN high ON high.level = u.level AND high.pos = xor(u.pos, 1::BIGINT) WHERE u.n > 1
), top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, upper.h AS folded_root, upper.h = root AS verified
FROM leaves JOIN upper USING (row_no) JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang, top WHERE upper.n = 1
"""
