"""DuckDB SQL of those queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Components of the pairs l(a, b) over nodes(id), as r(u, m): every node that u reaches.
REACHED = """
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT id, id FROM nodes),
r(u, m) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.m = e.u),
least_of AS (SELECT u AS id, min(m) AS component_id FROM r GROUP BY u)"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * o >= 85 * (len(x.g) + len(y.g) - o)),
nodes AS (SELECT doc_id AS id FROM documents), {REACHED}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN least_of ON id = doc_id"""

MIX_SOURCES = """
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, greatest(strlen(coalesce(text, '')), 1) AS size FROM documents),
z AS (SELECT source, sum(size) AS size, pow(CAST(sum(size) AS DOUBLE), 0.5) AS weight FROM d GROUP BY source),
q AS (SELECT source, weight / (SELECT CAST(sum(CAST(weight AS DECIMAL(38, 18))) AS DOUBLE) FROM z) * (SELECT sum(size) FROM z) / size AS rate FROM z),
t AS (SELECT source, rate, CAST(greatest(ceil(rate / 16.0), 1) AS INTEGER) AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM q),
c(source, mean, k, p, s) AS (SELECT source, mean, 0, exp(-mean), exp(-mean) FROM t
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM c WHERE k < 71),
u AS (SELECT d.*, t.rate, CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || j), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM (SELECT *, unnest(range(1, parts + 1)) AS j FROM t) t JOIN d ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT doc_id, source, text_md5, rate, sum((SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.s <= u.u)) AS n_copies FROM u GROUP BY ALL),
x AS (SELECT *, unnest(range(1, CAST(n_copies AS BIGINT) + 1)) AS copy FROM n)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, round(rate, 9) AS rate,
  md5('order 0|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy) AS shuffle_key, text_md5 FROM x"""

URL_FILTER = """
WITH rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT row, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (row)"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to FROM h"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id < q.id AND list_cosine_similarity(p.x, q.x) >= 0.9),
nodes AS (SELECT id FROM v), {REACHED}
SELECT least_of.id AS vec_id, (SELECT count(*) FROM l WHERE a = least_of.id OR b = least_of.id) AS n_links, component_id, least_of.id = component_id AS kept FROM least_of"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p+k-1], ' ') AS s
  FROM (SELECT *, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, k, p, item_id FROM dw JOIN iw USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)"""



def _merkle(levels: int = 13, top_levels: int = 6) -> str:
    """Trees of at most 3 ** levels leaves a source and 3 ** top_levels sources, one level after another."""
    def f(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text):
        return f"sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f(text)})"
    parts = [f"""c AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT documents.*, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, c),
b AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, {leaf("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS found FROM d),
w0 AS MATERIALIZED (SELECT doc_id, g, leaf, found AS acc, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM b),
n0 AS (SELECT g, i, leaf AS h FROM w0)"""]

    def climb(k, w, n, kept):
        join = f"{w}{k} w JOIN r{n}{k} r ON w.g IS NOT DISTINCT FROM r.g AND w.i // 3 = r.p"
        left, right = "array_to_string(hs[1:w.i % 3], '')", "array_to_string(hs[w.i % 3 + 2:], '')"
        return [f"""r{n}{k} AS MATERIALIZED (SELECT g, i // 3 AS p, list(h ORDER BY i) AS hs, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {n}{k}) GROUP BY ALL)""",
                f"""{n}{k + 1} AS (SELECT g, p AS i, CASE WHEN m = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{n}{k})""",
                f"""{w}{k + 1} AS MATERIALIZED (SELECT {kept}, w.g, CASE WHEN m = 1 THEN acc ELSE sha256({left} || acc || {right}) END AS acc, CASE WHEN m = 1 THEN proof ELSE proof || {left} || {right} END AS proof, r.p AS i FROM {join})"""]
    for k in range(levels):
        parts += climb(k, "w", "n", "doc_id, leaf")
    parts.append(f"""s AS (SELECT g AS own, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n{levels}), t0 AS (SELECT 0 AS g, i, subroot AS h FROM s),
v0 AS MATERIALIZED (SELECT doc_id, leaf, subroot, 0 AS g, acc, proof, s.i FROM w{levels} w JOIN s ON w.g IS NOT DISTINCT FROM s.own)""")
    for k in range(top_levels):
        parts += climb(k, "v", "t", "doc_id, leaf, subroot")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified FROM v{top_levels} v JOIN t{top_levels} t ON v.i = t.i"""


def _centroids(rounds: int = 5) -> str:
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
u AS MATERIALIZED (SELECT r, unnest(x) AS v, unnest(range(64)) AS d FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < 40),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS v, unnest(range(64)) AS d FROM s)"""]
    for k in range(rounds + 1):
        parts.append(f"""m{k} AS MATERIALIZED (SELECT r, min(q) % 64 AS c, min(q) // 64 AS distance
  FROM (SELECT r, c, CAST(sum((u.v - c.v) * (u.v - c.v)) AS BIGINT) * 64 + c AS q FROM u JOIN c{k} c USING (d) GROUP BY r, c) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c, d, coalesce(CAST((t - (t % n + n) % n) // n AS BIGINT), v) AS v
  FROM c{k} LEFT JOIN (SELECT c, d, sum(v) AS t, count(*) AS n FROM u JOIN m{k} USING (r) GROUP BY c, d) USING (c, d))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM m{rounds} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""


ORACLE = {"op1_ngram_join": NGRAM_JOIN, "op5_mix_sources": MIX_SOURCES, "op6_url_filter": URL_FILTER, "op7_warc": WARC,
          "op8_embedding_dedup": EMBEDDING_DEDUP, "op9_decontaminate": DECONTAMINATE, "op11_centroid_clustering": _centroids(),
          "op13_merkle_manifest": _merkle()}
