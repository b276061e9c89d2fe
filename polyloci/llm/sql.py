"""DuckDB SQL that states the result of a query independently of its Spark code."""

from __future__ import annotations

from .feistel import PRIME, permuted_sql

OP6 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), r AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM d WINDOW w AS (PARTITION BY t)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""

_BYTES = """flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE
    WHEN c = '' THEN []::BIGINT[]
    WHEN unicode(c) < 128 THEN [unicode(c)]
    WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
    WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
    ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END))"""

_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_table() -> str:
    steps = ["t0 AS (SELECT range AS i, range::BIGINT AS v FROM range(256))"]
    steps += [f"t{k + 1} AS (SELECT i, {_BIT.format('v')} AS v FROM t{k})" for k in range(8)]
    return ",\n".join([*steps, "crc_table AS (SELECT list(v ORDER BY i) AS t FROM t8)"])


OP9 = f"""
WITH {_crc_table()},
sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}::BIGINT[]),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS text_crc32
  FROM documents, crc_table
),
hashed AS (
  SELECT *, (((coalesce(doc_id % {PRIME}, 0) * 48271 + text_crc32 % {PRIME}) % {PRIME} * 48271 + size % {PRIME}) % {PRIME}) % 4096 AS bucket FROM sized
),
ordered AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS row FROM hashed),
{permuted_sql("ordered", "row", 20240917)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 40)::INTEGER AS shard, place // 40 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

OP11 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
             lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * i::INTEGER, 5))::BIGINT >> s::INTEGER & 31)::INTEGER, 1)), '')), '') AS payload_digest FROM p),
     r AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY hex) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN top END AS refers_to FROM r
"""

_CRC_DECIMAL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x))::BIGINT[]),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"""

OP12 = f"""
WITH {_crc_table()},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, c - c % 20 AS base, {_CRC_DECIMAL} % 4 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
rebuilt AS (
  SELECT v.c, 0 AS own, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.pos < v.h
  UNION ALL SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos >= v.h
),
lists AS (
  SELECT v.c, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.own, r.pos) FILTER (r.c IS NOT NULL), []) AS l
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c
),
prefixes AS (SELECT c, len(l) AS size, unnest(range(0, len(l) + 1)) AS depth, l FROM lists),
keyed AS (SELECT c, size, depth, l[1:depth] AS key FROM prefixes),
nodes AS (
  SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth
),
placed AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.key[n.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY ALL),
sized AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM placed p LEFT JOIN children k USING (conv_id, depth)),
above AS (SELECT unnest(range(0, depth + 1)) AS top, key, saved, n_children FROM sized),
sums AS (SELECT top AS depth, key[1:top] AS key, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM sized JOIN sums USING (depth, key)
"""

OP13 = """
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM lowered),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f
  FROM spots, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
),
parted AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lft, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rgt
  FROM grams, (VALUES (1), (2), (3)) AS s(k) WHERE k < words
),
cuts AS (
  SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM parted p JOIN grams x ON x.lang = p.lang AND x.phrase = lft JOIN grams y ON y.lang = p.lang AND y.phrase = rgt
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM grams, (VALUES (2), (3)) AS z(k), (VALUES (1), (2), (3)) AS o(i) WHERE k < words AND i + k - 1 <= words GROUP BY ALL
),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op6_exact_dedup": OP6, "op9_sharding": OP9, "op11_warc": OP11, "op12_conversation_trie": OP12, "op13_collocations": OP13}
