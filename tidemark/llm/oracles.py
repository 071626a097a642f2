"""What DuckDB says for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import mixing, quality, sharding

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def sql(pattern: str, flags: str = "") -> str:
    """A pattern of ``quality`` as a string of SQL."""
    return "'" + flags + pattern.replace("'", "''") + "'"


CLOSED = sql(quality.CLOSED.pattern.replace("\\Z", "$"))
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS x(k) GROUP BY r),
ln AS (SELECT r, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS seen
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
ju AS (SELECT *, regexp_matches(line, {CLOSED}) AS closed FROM ln WHERE n > 0),
ok AS (SELECT r, n, seen, NOT (
    seen
    OR len(regexp_extract_all(line, {sql(quality.SEPARATOR.pattern)})) >= 2
    OR (n <= 12 AND NOT closed AND regexp_matches(line, {sql(quality.MENU.pattern, "(?i)")}))
    OR (n <= 40 AND regexp_matches(line, {sql(quality.NOTICE.pattern, "(?i)")}))
    OR 10 * len(regexp_extract_all(line, {sql(quality.MARKS.pattern)})) > n
    OR (NOT closed AND NOT (n >= 15 AND regexp_matches(line, '[\pL\pN][.!?。！？]["''”’»)]?[ \t]')))
    OR (n >= 3 AND line = upper(line) AND line <> lower(line))) AS good FROM ju),
ls AS (SELECT r, sum(seen::INT)::BIGINT AS dup, coalesce(sum(n) FILTER (good), 0)::BIGINT AS kept FROM ok GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       coalesce(kept, 0) AS n_kept_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w)) AND coalesce(kept, 0) >= 0.5 * len(w) AS kept
FROM w LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.node),
c AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY ALL)
SELECT n.doc_id, n.n AS n_shingles, min(reach.node) AS component_id, coalesce(max(c.n_links), 0) AS n_links FROM n JOIN reach USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY n.doc_id, n.n
"""

CRC = """
tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: (c >> 1) ^ (CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), i) AS c FROM range(256) x(i))),
bytes AS (SELECT r, doc_id, strlen(text) + 1 AS size, list_transform(range(strlen(text)), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT *, hex(encode(text)) AS h FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents))),
sz AS (SELECT r, doc_id, size::BIGINT AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, tb)
""".replace("(c >> 1) ^ (CASE", "xor(c >> 1, (CASE").replace("ELSE 0 END), i)", "ELSE 0 END)), i)")


def shards(n_shards: int, seed: int) -> str:
    """The permutation in SQL: every step of the walk takes the places that are not below n once more."""
    stir = lambda x, k: f"((xor((({x} + {k}) * 48271) % 2147483647, ((({x} + {k}) * 48271) % 2147483647) >> 15) + {k}) * 69621) % 2147483647"

    def once(rows: str) -> str:
        out = f"SELECT *, p % a AS l, p // a AS r FROM {rows}"
        for i, key in enumerate(sharding.KEYS):
            k = key + seed
            new = f"l, (r + {stir('l', k)}) % b AS r" if i % 2 else f"(l + {stir('r', k)}) % a AS l, r"
            out = f"SELECT * EXCLUDE (l, r), {new} FROM ({out})"
        return f"SELECT * EXCLUDE (l, r, p), r * a + l AS p FROM ({out})"

    return f"""WITH RECURSIVE {CRC},
nn AS (SELECT count(*) AS n, CASE WHEN count(*) <= 1 THEN 1 ELSE floor(sqrt(count(*) - 1))::BIGINT + 1 END AS f FROM documents),
ab AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, f, unnest(range(f, f + least({sharding.SEARCH}, f // 4 + 1))) AS a FROM nn) ORDER BY a * ((n + a - 1) // a) - n, a LIMIT 1),
w0 AS (SELECT doc_id, size, text_crc32, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS p FROM sz, ab),
walk AS ({once('w0')} UNION ALL {once('(SELECT * FROM walk WHERE p >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {n_shards})::INT AS shard, p // {n_shards} AS slot, NULL::INT AS grown_shard FROM walk WHERE p < n"""


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LETTERS = " || ".join(f"substr('{BASE32}', ((v[{g}] >> {shift}) & 31) + 1, 1)" for g in range(1, 9) for shift in (15, 10, 5, 0))
WARC = f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
v AS (SELECT page_id, strlen(html) AS bytes, sha1(html) AS s, list_transform(range(8), lambda g: ('0x' || substr(sha1(html), 5 * g + 1, 5))::BIGINT) AS v, min(page_id) OVER (PARTITION BY html) AS first FROM h)
SELECT page_id, bytes AS payload_bytes, {LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v
"""

ORACLES = {"op2_quality": QUALITY, "op3_jaccard": JACCARD, "op7_sharding": shards(16, 0), "op8_mixing": mixing.ORACLE.format(seed=17), "op10_warc": WARC}
