"""SQL that gives the rows of a query of this subpackage, where SQL can express it."""

OP7 = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
),
r AS (
    SELECT doc_id, sha256(norm) AS text_sha256,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = 1 AS kept
    FROM n
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""

_URLS = r"""
u AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
)
"""


def _strength(table: str) -> str:
    """The method-of-moments strength of a level's prior."""
    return f"""(
        SELECT least(greatest(CASE WHEN g > 0 AND s > e THEN 1 / ((s - e) / g) - 1 ELSE 1000.0 END, 2.0), 1000.0)
        FROM (SELECT sum((bad - n * above) ** 2) AS s, sum(n * above * (1 - above)) AS e,
                     sum(n * above * (1 - above) * (n - 1)) AS g FROM {table})
    )"""


OP1 = f"""
WITH {_URLS},
o AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
c AS (
    SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
    FROM u LEFT JOIN o ON page_id = doc_id GROUP BY host
),
h AS (
    SELECT *, string_split(host, '.')[-1] AS suffix,
           array_to_string(string_split(host, '.')[-2:], '.') AS domain
    FROM c
),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) FROM s0) AS above FROM s0),
s2 AS (SELECT suffix, (bad + k * above) / (n + k) AS rate FROM s1, (SELECT {_strength("s1")} AS k)),
d1 AS (SELECT d.*, rate AS above FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT suffix, domain, (bad + k * above) / (n + k) AS rate FROM d1, (SELECT {_strength("d1")} AS k)),
h1 AS (SELECT h.*, rate AS above FROM h JOIN d2 USING (suffix, domain)),
h2 AS (
    SELECT host, (bad + k * above) / (n + k) AS rate, n + k AS weight FROM h1, (SELECT {_strength("h1")} AS k)
),
j AS (
    SELECT page_id, u.host, path, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS bound,
           CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%'
                THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
    FROM u JOIN h2 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

OP4 = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
g AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])
                   END AS grams
    FROM w
),
x AS (SELECT doc_id, unnest(grams) AS gram FROM g),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY ALL
),
l AS (
    SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b
    WHERE 100 * shared >= 75 * (len(ga.grams) + len(gb.grams) - shared)
),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = doc_id) AS component_id FROM g
"""


def _crc_table() -> str:
    """The 256 entries of the CRC-32 table, by its rule."""
    step = "SELECT i, CAST(i AS BIGINT) AS x FROM range(256) r(i)"
    for _ in range(8):
        step = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({step})"
    return step


OP13 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS entries FROM ({_crc_table()})),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents)),
kinds AS (
    SELECT w, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
           lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END)) AS bytes
    FROM (SELECT doc_id, w, count(*) AS times FROM runs GROUP BY ALL)),
hashed AS (
    SELECT w, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
           lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
    FROM kinds, crc),
words AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word
        FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS MATERIALIZED (
    SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
    SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (
    SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
    FROM near JOIN words o ON near.other = o.word),
formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
           CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON w.word = r.word),
chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON chain.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed l ON c.at = l.word WHERE l.form IS NULL
"""
