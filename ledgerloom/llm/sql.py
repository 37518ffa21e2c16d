"""DuckDB SQL for the queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS k
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT n FROM p),
     o AS (SELECT DISTINCT x.doc_id, x.i, x.n, p.item_id
           FROM (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)) x
           JOIN p ON x.k = p.k AND x.n = p.n),
     h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY 1),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
           WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
     r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) c USING (doc_id)
"""

OP4 = """
WITH sizes AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1),
     rates AS (SELECT source, CASE WHEN chars > 0
                      THEN sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars ELSE 0 END AS rate FROM sizes),
     parts AS (SELECT source, rate, greatest(ceil(rate / 32), 1)::BIGINT AS parts FROM rates),
     cdf AS (SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
             FROM parts, range(0, 113) t(k) WHERE rate > 0),
     drawn AS (SELECT d.doc_id, p.source, p.rate, part,
                      (('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || part::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296 AS u
               FROM documents d JOIN parts p ON coalesce(d.source, '') = p.source, unnest(range(1, p.parts + 1)) t(part)),
     counted AS (SELECT doc_id, source, rate, count(*) FILTER (WHERE c.c < u)::BIGINT AS n_copies
                 FROM drawn JOIN cdf c USING (source) GROUP BY 1, 2, 3)
SELECT doc_id, source, n_copies, copy, round(rate, 6) AS rate,
       md5('1:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS order_key
FROM counted, unnest(range(0, n_copies)) t(copy)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
     f AS (SELECT k, min(doc_id) AS m FROM x GROUP BY 1),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (k) WHERE f.m < x.doc_id),
     g AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
     k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM g ANTI JOIN c USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     x AS (SELECT i, lang, source, unnest(w) AS term FROM d),
     v AS (SELECT lang, term, count(*)::HUGEINT AS c FROM x GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
     vs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY 1),
     c AS (SELECT x.lang, x.source, x.term, count(*)::HUGEINT AS c FROM x JOIN v USING (lang, term) GROUP BY 1, 2, 3),
     n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
     p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * vs.v) AS p,
                  1 + (1000000000::HUGEINT * (v.c + 2)) // (vs.n + 2 * vs.v) AS q
           FROM g JOIN v USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
           LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) f
               ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""

OP12 = """
WITH RECURSIVE
     poly AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, x: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS t),
     d AS (SELECT doc_id, lang, coalesce('1' || lang, '0') AS key,
                  CASE WHEN doc_id IS NULL THEN NULL ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                       lambda r, x: xor(r // 256, t[xor(r, x) % 256 + 1]))) END AS crc, n_chars,
                  CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
                  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z FROM documents, poly),
     f AS (SELECT doc_id, key, crc, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z) AS leaf,
                  CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(a || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || z) END AS changed FROM d),
     l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM f),
     lower AS (SELECT key, 0 AS lvl, pos, n, leaf AS h FROM l
               UNION ALL SELECT key, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower WHERE n > 1 GROUP BY key, lvl, n, pos // 2),
     s AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1),
     upper AS (SELECT 0 AS lvl, pos, n, h FROM s
               UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, n, pos // 2),
     nodes AS (SELECT key, lvl, pos, n, h FROM lower UNION ALL SELECT NULL, lvl, pos, n, h FROM upper),
     walk AS (SELECT doc_id, l.key, l.pos AS id, l.key AS tree, 0 AS lvl, l.pos, l.n, '' AS proof, coalesce(changed, leaf) AS h FROM l
              UNION ALL SELECT w.doc_id, w.key, w.id, CASE WHEN w.n = 1 THEN NULL ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END,
                     CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 1) // 2 END,
                     w.proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(o.h, '') END,
                     CASE WHEN w.n = 1 THEN w.h WHEN w.pos % 2 = 0 THEN sha256(w.h || coalesce(o.h, '')) ELSE sha256(o.h || w.h) END
              FROM walk w JOIN s USING (key) LEFT JOIN nodes o ON o.key IS NOT DISTINCT FROM w.tree AND o.lvl = w.lvl AND o.pos = xor(w.pos, 1)
              WHERE w.n > 1 OR w.tree IS NOT NULL),
     root AS (SELECT h FROM upper WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root.h AS verified
FROM l JOIN s USING (key) JOIN walk w ON w.key = l.key AND w.id = l.pos AND w.tree IS NULL AND w.n = 1, root
"""

OP11 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     m AS (SELECT html, max(page_id) AS leader FROM p GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
           ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to, url
FROM p JOIN m USING (html)
"""
