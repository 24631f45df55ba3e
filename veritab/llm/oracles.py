"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS original FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
        substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * (strpos('0123456789abcdef', substr(x, i, 1)) - 1)::INT + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
           + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
           + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM b
"""

OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

OP1 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP7 = """
WITH b AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS last FROM b WHERE role = 'assistant' GROUP BY pair_id),
c AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM b),
j AS (
  SELECT b.pair_id, turn, role, text FROM b LEFT JOIN l USING (pair_id) WHERE last IS NULL OR turn IS NULL OR turn < last
  UNION ALL
  SELECT b.pair_id - 1, turn + 1099511627776, role, text FROM b JOIN l USING (pair_id) WHERE turn >= last AND b.pair_id - 1 IN (SELECT pair_id FROM b)),
r AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM j),
p AS (
  SELECT pair_id, i FROM c UNION SELECT pair_id, i FROM r),
f AS (
  SELECT p.pair_id, coalesce(min(p.i) FILTER (WHERE NOT coalesce(c.role = r.role AND c.text = r.text, false)) - 1, count(*)) AS n
  FROM p LEFT JOIN c ON c.pair_id = p.pair_id AND c.i = p.i LEFT JOIN r ON r.pair_id = p.pair_id AND r.i = p.i GROUP BY p.pair_id),
t AS (
  SELECT 'c' AS side, c.pair_id, i, i > n AS after, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x FROM c JOIN f USING (pair_id)
  UNION ALL
  SELECT 'r', r.pair_id, i, i > n, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) FROM r JOIN f USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY side, pair_id, after ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM t)
SELECT f.pair_id, n AS prompt_turns,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 'c' AND NOT after), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 'c' AND after), '') AS chosen_completion,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 'r' AND after), '') AS rejected_completion,
  coalesce(string_agg((off + length(role) + 5) || '-' || (off + length(x)), ';' ORDER BY i) FILTER (WHERE side = 'c' AND after AND role = 'assistant'), '') AS chosen_trained,
  coalesce(string_agg((off + length(role) + 5) || '-' || (off + length(x)), ';' ORDER BY i) FILTER (WHERE side = 'r' AND after AND role = 'assistant'), '') AS rejected_trained
FROM f JOIN o ON o.pair_id = f.pair_id GROUP BY f.pair_id, n
"""

#: op8's model in SQL over scored(doc_id, text, train); a test compares it within a tolerance, since the order of sums differs.
KATZ = """
WITH d AS (
  SELECT doc_id, train, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), chr(10)) AS w
  FROM scored),
t AS MATERIALIZED (SELECT doc_id, train, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS prev, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
uni AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS c FROM t WHERE train GROUP BY word),
big AS MATERIALIZED (SELECT prev, word, count(*)::DOUBLE AS c FROM t WHERE train GROUP BY prev, word),
total AS MATERIALIZED (SELECT sum(c) AS n, count(*) AS v FROM uni),
many AS (SELECT 'uni' AS kind, c FROM uni UNION ALL SELECT 'big', c FROM big),
n AS MATERIALIZED (SELECT kind, r, (SELECT count(*) FROM many m WHERE m.kind = k.kind AND m.c = r)::DOUBLE AS n FROM (VALUES ('uni'), ('big')) AS k(kind), range(1, 7) AS u(r)),
g AS (
  SELECT a.kind, a.r, a.n AS n_r, b.n AS n_next, o.n AS n1, two.n AS n2, 6 * six.n / nullif(o.n, 0) AS common
  FROM n a JOIN n b ON b.kind = a.kind AND b.r = a.r + 1 JOIN n o ON o.kind = a.kind AND o.r = 1 JOIN n two ON two.kind = a.kind AND two.r = 2 JOIN n six ON six.kind = a.kind AND six.r = 6),
gt AS (SELECT *, ((r + 1) * n_next / nullif(r * n_r, 0) - common) / nullif(1 - common, 0) AS good FROM g),
disc AS MATERIALIZED (
  SELECT kind, r, CASE WHEN bool_and(coalesce(good > 0 AND good < 1, false)) OVER (PARTITION BY kind) THEN good WHEN n1 = 0 THEN 1 WHEN n2 > 0 THEN (r - n1 / (n1 + 2 * n2)) / r ELSE (r - 0.5) / r END AS d FROM gt),
u0 AS MATERIALIZED (SELECT word, c, coalesce(d, 1) * c / (SELECT n FROM total) AS p FROM uni LEFT JOIN disc ON kind = 'uni' AND r = c),
u1 AS MATERIALIZED (SELECT CASE WHEN 1 - sum(p) < 1e-12 THEN (SELECT n / (n + 1) FROM total) ELSE 1 END AS scale, sum(p) AS s FROM u0),
low AS MATERIALIZED (SELECT word, c, p * scale AS p FROM u0, u1),
hist AS MATERIALIZED (SELECT prev, sum(c) + (NOT bool_or(c <= 5))::INT AS n FROM big GROUP BY prev),
seen AS MATERIALIZED (SELECT big.prev, big.word, coalesce(d, 1) * big.c / hist.n AS p FROM big JOIN hist USING (prev) LEFT JOIN disc ON kind = 'big' AND r = big.c),
alpha AS MATERIALIZED (SELECT prev, (1 - sum(seen.p)) / (1 - sum(low.p)) AS a FROM seen JOIN low USING (word) GROUP BY prev),
x AS (
  SELECT t.doc_id, coalesce(low.c, 0) AS c, coalesce(seen.p, coalesce(a, 1) * coalesce(low.p, (SELECT 1 - s * scale FROM u1))) AS p
  FROM t LEFT JOIN low USING (word) LEFT JOIN seen ON seen.prev = t.prev AND seen.word = t.word LEFT JOIN alpha ON alpha.prev = t.prev)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, (SELECT n FROM total)::BIGINT AS train_tokens,
  sum(log10((c + 1) / (SELECT n + v + 1 FROM total))) AS base_score, sum(log10(p)) AS score FROM x GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op1_exact_top_k": OP1, "op2_warc_round_trip": OP2, "op6_lsh_forest": OP6, "op7_preference_format": OP7, "op9_exact_dedup": OP9}
