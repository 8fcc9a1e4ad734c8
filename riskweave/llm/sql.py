"""DuckDB SQL beside the queries that SQL can express on whole tables."""

ESCAPED = r"""regexp_replace(regexp_replace(coalesce(text, ''), '\\', '\\\\', 'g'), '(<)(\||/?s>|/?SYS>>|/SYS)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"""
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), parts AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {ESCAPED} AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn:') + length(url_encode(role)) + length('|>') + length(body) + length('<|end|>'))::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), items AS (
  SELECT item_id, {WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), found AS (
  SELECT p.r, p.i, w.size, w.item_id
  FROM (SELECT r, s.size, i, array_to_string(w[i:i + s.size - 1], ' ') AS win
        FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) AS d, sizes AS s WHERE i + s.size - 1 <= len(w)) AS p
  JOIN windows AS w ON w.size = p.size AND w.win = p.win
), hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM found) GROUP BY r
), who AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN who USING (r)
"""



def _levels(name: str, start: str) -> str:
    """Nodes of all levels of ``start`` (tree, idx, digest, n); n is the number of nodes of the tree's level."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, idx, digest, n FROM {start}
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 8, n
)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


# crc32 of the id's digits, by table-free bit steps, since the engine has no crc32.
MERKLE = f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, 0 AS step, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, step + 1,
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT doc_id, step, CASE WHEN step % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM bits)
  WHERE step < 8 * length(doc_id::VARCHAR)
), crc AS (
  SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM bits WHERE step = 8 * length(doc_id::VARCHAR)
), hashed AS (
  SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered
  FROM documents
), leaves AS (
  SELECT doc_id, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS now, leaf AS digest,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed AS h LEFT JOIN crc USING (doc_id)
), {_levels("nodes", "leaves")}, subroots AS (
  SELECT 0 AS tree, tree AS idx, digest, (SELECT count(DISTINCT tree) FROM leaves) AS n FROM nodes WHERE n = 1
), {_levels("tops", "subroots")}, every AS (
  SELECT false AS top, tree, level, idx, digest, n FROM nodes UNION ALL SELECT true, tree, level, idx, digest, n FROM tops
), climb AS (
  SELECT tree AS leaf_tree, idx AS leaf_idx, false AS top, tree, 0 AS level, idx, n, now AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT leaf_tree, leaf_idx, top, tree, level + 1, idx // 8, (n + 7) // 8,
    sha256(coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < idx), '') || folded || coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > idx), '')),
    proof || coalesce(string_agg(digest, '' ORDER BY place) FILTER (place <> idx), '')
  FROM (
    SELECT c.leaf_tree, c.leaf_idx, c.top, c.tree, c.level, c.idx, c.n, c.folded, c.proof, e.idx AS place, e.digest
    FROM (SELECT leaf_tree, leaf_idx, top OR n = 1 AS top, CASE WHEN NOT top AND n = 1 THEN 0 ELSE tree END AS tree,
            CASE WHEN NOT top AND n = 1 THEN 0 ELSE level END AS level, CASE WHEN NOT top AND n = 1 THEN tree ELSE idx END AS idx,
            CASE WHEN NOT top AND n = 1 THEN (SELECT count(DISTINCT tree) FROM leaves) ELSE n END AS n, folded, proof FROM climb) AS c
    JOIN every AS e ON e.top = c.top AND e.tree = c.tree AND e.level = c.level AND e.idx // 8 = c.idx // 8
    WHERE c.n > 1)
  GROUP BY leaf_tree, leaf_idx, top, tree, level, idx, n, folded, proof
), ends AS (
  SELECT leaf_tree, leaf_idx, max_by(folded, length(proof)) AS folded_root, max_by(proof, length(proof)) AS proof
  FROM (SELECT *, row_number() OVER (PARTITION BY leaf_tree, leaf_idx ORDER BY top DESC, level DESC) AS last FROM climb) WHERE last = 1 GROUP BY ALL
), root AS (
  SELECT digest AS root FROM tops WHERE n = 1
)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves AS l JOIN ends AS e ON e.leaf_tree = l.tree AND e.leaf_idx = l.idx JOIN subroots AS s ON s.idx = l.tree CROSS JOIN root
"""

ORACLES = {"op3_chat_format": CHAT, "op6_decontamination": DECONTAMINATION, "op11_merkle_manifest": MERKLE}
