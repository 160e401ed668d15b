"""SQL that the queries of this package are checked against, where SQL can express them."""

from __future__ import annotations

# Components of the pairs l(x, y), which hold both directions: everything that can be reached.
_REACHED = """
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)"""

# Length-prefixed fields of a document, with {text} in place of its text.
_FIELDS = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))),
 lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT) ELSE 0 END)),
 lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"""

# Levels of the trees in {nodes}(tree, pos, node, n), and the run around every leaf of them at every level.
_LEVELS = """
{name} AS (SELECT tree, 0 AS level, pos, node, n FROM {nodes}
 UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1
 GROUP BY tree, level, n, pos // 8),
{name}_runs AS (SELECT l.tree, l.pos, t.level,
  coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(8 ** t.level AS BIGINT)), '') AS before,
  coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(8 ** t.level AS BIGINT)), '') AS after
 FROM {nodes} l JOIN {name} t ON t.tree = l.tree AND t.n > 1 AND t.pos // 8 = l.pos // CAST(8 ** (t.level + 1) AS BIGINT)
 GROUP BY l.tree, l.pos, t.level)"""

ORACLES: dict[str, str] = {
    "op11_line_dedup": f"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, r, ls, list_transform(ls, lambda x: {_LOWER.format(f"trim(x, {_BLANKS})")}) AS ks FROM l),
h AS (SELECT k, max(doc_id) AS largest FROM (SELECT DISTINCT r, doc_id, unnest(ks) AS k FROM k) d WHERE length(k) >= 20
 GROUP BY k HAVING count(*) >= 3),
u AS (SELECT r, doc_id, unnest(ls) AS line, unnest(ks) AS k, generate_subscripts(ls, 1) AS pos FROM k),
f AS (SELECT u.*, coalesce(largest <> doc_id, false) AS dropped FROM u LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM f GROUP BY r, doc_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS.replace("{text}", "text")}) AS leaf,
 CASE WHEN {_CRC} % 3 = 0 THEN sha256({_FIELDS.replace("{text}", _LOWER.format("text"))}) END AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node,
 count(*) OVER (PARTITION BY tree) AS n FROM d),{_LEVELS.format(name="t", nodes="p")},
s AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, node, count(*) OVER () AS n FROM t WHERE n = 1),{_LEVELS.format(name="u", nodes="s")},
steps AS (SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY part, level) AS k, before, after FROM (
 SELECT tree, pos, 0 AS part, level, before, after FROM t_runs
 UNION ALL SELECT p.tree, p.pos, 1, r.level, r.before, r.after FROM p JOIN s ON s.name = p.tree JOIN u_runs r ON r.pos = s.pos) x),
f AS (SELECT tree, pos, CAST(0 AS BIGINT) AS k, coalesce(claimed, leaf) AS node FROM p
 UNION ALL SELECT f.tree, f.pos, f.k + 1, sha256(before || f.node || after) FROM f JOIN steps g ON g.tree = f.tree AND g.pos = f.pos AND g.k = f.k + 1),
e AS (SELECT tree, pos, arg_max(node, k) AS folded_root FROM f GROUP BY tree, pos),
q AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY tree, pos)
SELECT doc_id, leaf, s.node AS subroot, z.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = z.node AS verified
FROM p JOIN s ON s.name = p.tree JOIN (SELECT node FROM u WHERE n = 1) z ON true JOIN e ON e.tree = p.tree AND e.pos = p.pos
LEFT JOIN q ON q.tree = p.tree AND q.pos = p.pos""",
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
  lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),{_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
 doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM s LEFT JOIN c ON x = doc_id""",
    "op8_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),{_REACHED}
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
 vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM v LEFT JOIN c ON x = vec_id""",
    "op6_warc_writer": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, CAST(from_hex(sha1(body)) AS BIT)::VARCHAR AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
  + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f""",
}
