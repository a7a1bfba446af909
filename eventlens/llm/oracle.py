"""The results of the operators that SQL can express, as DuckDB SQL over the tables."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s:s + least(10, len(w)) - 1] AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
        FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
places AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS span
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths)),
found AS (
  SELECT doc_id, s, n, span FROM places WHERE span IN (SELECT span FROM p)),
words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT doc_id, p.item_id::VARCHAR AS item_id FROM found JOIN p USING (span))
  GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY a, b, nx.n, ny.n
  HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""

# Bytes as two hexadecimal digits each; strings are told by 64-bit hashes.
OP6 = r"""
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x,
    octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (
  SELECT doc_id, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY h) AS again
  FROM (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS h
        FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d))),
r AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i,
          CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new
        FROM s WHERE again)),
spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b
  FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d)),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS x
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
  FROM pages),
r AS (SELECT html, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN r ON p.html = r.html
"""

#: One round: distances to all centroids, the nearest of each vector, and their means.
_ROUND = """
a{r} AS MATERIALIZED (
  SELECT id, v, c, d FROM (
    SELECT id, v, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) ** 2))::BIGINT AS d
    FROM k CROSS JOIN c{r})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1),
c{s} AS MATERIALIZED (
  SELECT c, list(coalesce(m, old) ORDER BY i) AS x FROM (
    SELECT c, i, x[i] AS old, (t - ((t % n) + n) % n) // n AS m
    FROM (SELECT c, x, unnest(range(1, 65)) AS i FROM c{r})
    LEFT JOIN (
      SELECT c, i, sum(y)::BIGINT AS t, count(*) AS n
      FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS y FROM a{r}) GROUP BY c, i) USING (c, i))
  GROUP BY c),
"""

OP11 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS x FROM k
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= 40),
{"".join(_ROUND.format(r=r, s=r + 1) for r in range(6))}
inertia AS (SELECT c, sum(d)::BIGINT AS s FROM a5 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, s AS cluster_inertia,
  (SELECT sum(s)::BIGINT FROM inertia) AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a5 JOIN k USING (id) JOIN inertia USING (c) JOIN c5 USING (c)
"""

# Levels of the trees are lists of hashes; CRC-32 is computed bit by bit.
OP13 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    text,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                     ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS inverse_crc
  FROM documents),
h AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN inverse_crc & 1 = 1 THEN sha256(head || coalesce(
      strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS cut
  FROM d),
i AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i
  FROM h),
s(source, k, l) AS (
  SELECT source, 0, list(leaf ORDER BY i) FROM i GROUP BY source
  UNION ALL
  SELECT source, k + 1, [sha256(array_to_string(l[3 * j + 1:3 * j + 3], ''))
                         for j in range(0, (len(l) + 2) // 3)]
  FROM s WHERE len(l) > 1),
subroots AS (
  SELECT source, k AS height, l[1] AS subroot,
    row_number() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS j
  FROM s WHERE len(l) = 1),
t(k, l) AS (
  SELECT 0, list(subroot ORDER BY j) FROM subroots
  UNION ALL
  SELECT k + 1, [sha256(array_to_string(l[3 * j + 1:3 * j + 3], ''))
                 for j in range(0, (len(l) + 2) // 3)]
  FROM t WHERE len(l) > 1),
steps AS (
  SELECT r, k, l, i // (3 ** k)::BIGINT AS x
  FROM i JOIN s ON i.source IS NOT DISTINCT FROM s.source WHERE len(l) > 1
  UNION ALL
  SELECT r, height + k, l, j // (3 ** k)::BIGINT
  FROM i JOIN subroots ON i.source IS NOT DISTINCT FROM subroots.source CROSS JOIN t
  WHERE len(l) > 1),
near AS (
  SELECT r, k, array_to_string(l[x // 3 * 3 + 1:x], '') AS a,
    array_to_string(l[x + 2:x // 3 * 3 + 3], '') AS b
  FROM steps),
proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM near GROUP BY r),
f(r, k, hash) AS (
  SELECT r, 0, coalesce(cut, leaf) FROM i
  UNION ALL
  SELECT f.r, f.k + 1, sha256(a || hash || b) FROM f JOIN near ON near.r = f.r AND near.k = f.k),
ends AS (SELECT r, arg_max(hash, k) AS folded FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
  folded AS folded_root, folded = root AS verified
FROM i JOIN subroots ON i.source IS NOT DISTINCT FROM subroots.source
  JOIN ends USING (r) LEFT JOIN proofs USING (r)
  CROSS JOIN (SELECT l[1] AS root FROM t WHERE len(l) = 1)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_decontamination": OP2,
        "op3_ngram_jaccard_join": OP3,
        "op4_exact_dedup": OP4,
        "op6_suffix_array_dedup": OP6,
        "op8_warc_salvage": OP8,
        "op11_centroid_clustering": OP11,
        "op13_merkle_manifest": OP13,
    }
