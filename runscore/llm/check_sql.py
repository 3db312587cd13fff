"""The rules of three queries again, in SQL."""

WORDS = r"[^\x20\x09-\x0D]+"

# crc32 of a decimal number, bit by bit: every byte meets the register, then eight shifts
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
        lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))))"""

PREFIX_TRIE = rf"""
WITH RECURSIVE own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, c - c % 20 AS first, {_CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
    SELECT i.c, o.n, o.role, o.body FROM ids i JOIN own o ON o.c = i.first AND o.n <= i.h
    UNION ALL
    SELECT i.c, o.n, o.role, o.body FROM ids i JOIN own o ON o.c = i.c AND o.n > i.h
), turns AS (
    SELECT c, row_number() OVER w AS d, len(regexp_extract_all(body, '{WORDS}')) AS words,
           md5(string_agg(len(role) || ':' || role || len(body) || ':' || body, '') OVER w) AS id
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY n ROWS UNBOUNDED PRECEDING)
), chain AS (
    SELECT c, d, id, words FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids
), whole AS (
    SELECT c, max(d) AS last FROM chain GROUP BY c
), nodes AS (
    SELECT d, id, min(c) AS c, count(*) AS n, max(words) AS words,
           count(*) FILTER (d = last) AS n_ends,
           coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '') AS ends
    FROM chain JOIN whole USING (c) GROUP BY d, id
), links AS (
    SELECT n.d, n.id, p.id AS parent, q.c AS parent_c
    FROM nodes n JOIN chain p ON p.c = n.c AND p.d = n.d - 1 JOIN nodes q ON q.d = p.d AND q.id = p.id
), children AS (
    SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM links GROUP BY ALL
), totals AS (
    SELECT a.d, a.id, sum(CASE WHEN n.n = n.n_ends THEN 1 ELSE 0 END) AS n_leaves,
           sum((n.n - 1) * n.words) AS saved_tokens
    FROM nodes n JOIN chain a ON a.c = n.c AND a.d <= n.d GROUP BY a.d, a.id
)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, l.parent_c AS parent_conv_id, n.n AS n_convs,
       coalesce(k.n_children, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t USING (d, id) LEFT JOIN links l USING (d, id) LEFT JOIN children k USING (d, id)
"""


def _books(number: int) -> str:
    """Assignment with the books of one round, and the books of the next."""
    return f"""near{number} AS (
    SELECT r, p, min(dist * 64 + e) % 64 AS e, min(dist * 64 + e) // 64 AS dist FROM (
        SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS dist
        FROM cells x JOIN book{number} b ON b.p = x.p AND b.j = x.j GROUP BY x.r, x.p, b.e)
    GROUP BY r, p
), book{number + 1} AS (
    SELECT b.p, b.e, b.j, coalesce(CAST(floor(sum(x.v) / count(x.v)) AS BIGINT), any_value(b.v)) AS v
    FROM book{number} b LEFT JOIN near{number} n ON n.p = b.p AND n.e = b.e
    LEFT JOIN cells x ON x.r = n.r AND x.p = b.p AND x.j = b.j GROUP BY b.p, b.e, b.j
)"""


VECTOR_CODES = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
    SELECT r, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS j, v[i] AS v
    FROM kept, generate_series(1, len(v)) AS places(i)
), book0 AS (
    SELECT p, r AS e, j, v FROM cells WHERE r < 64
), {_books(0)}, {_books(1)}, {_books(2)}, codes AS (
    SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
    FROM near2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM kept JOIN codes USING (r)
"""

URL_RULES = r"""
WITH rules(host, path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), places AS (
    SELECT *, row_number() OVER () AS n FROM parts
), fits AS (
    SELECT n, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(r.verdict, len(r.host || r.path)) AS verdict
    FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM places LEFT JOIN fits USING (n)
"""
