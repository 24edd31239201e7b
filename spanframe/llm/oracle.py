"""SQL, for a second engine (DuckDB) on the same tables, of the training-data queries that SQL can express."""

from __future__ import annotations

from spanframe.llm import chat, warc

#: Archives hold each page once as a record; of equal payloads that aren't short, the page of the smallest id answers.
WARC = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, payload_bytes >= {warc.WarcParams().least_shared} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url FROM r"""


def _layout(*names: str) -> str:
    return f"'{chat.path_hash(*names):016x}'"


def _chat() -> str:
    listed = lambda turns, role, text: _layout(f".{turns}", f".{turns}[]", f".{turns}[].{role}", f".{turns}[].{text}")  # noqa: E731
    marks = len(chat.OPEN) + 1 + len(chat.CLOSE)
    escapes = lambda c: rf"length({c}) + len(regexp_extract_all({c}, '<\\*\|'))"  # noqa: E731
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    order = "ORDER BY turn, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
g AS (SELECT conv_id, count(*) AS n_turns, list(role {order}) AS roles, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns,
  coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss, sum({marks} + {escapes(role)} + {escapes('text')}) AS formatted_chars,
  (coalesce(conv_id, 0) % 4 + 4) % 4 AS kind, bool_and(role IN ('system', 'user', 'assistant')) AS known FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] AND kind = 1 THEN {_layout('.prompt', '.completion')} WHEN roles = ['user', 'assistant'] AND kind = 2 THEN {_layout('.instruction', '.output')}
  WHEN roles = ['system', 'user', 'assistant'] AND kind = 1 THEN {_layout('.system', '.prompt', '.response')} WHEN known AND kind = 3 THEN {listed('conversations', 'from', 'value')}
  ELSE {listed('messages', 'role', 'content')} END AS layout FROM g"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of the codebooks, unrolled: x has a row for each row and part, b0, b1, .. the entries of each round."""
    apart = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
    sql = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})"""
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.v) AS v, min({apart}) AS d, arg_min(b.e, ({apart}, b.e)) AS e FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.r, x.p)"  # noqa: E731
    for k in range(rounds):
        sql += f""",\n{near(k)},
m{k} AS (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS c FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)"""
    return f"""{sql},\n{near(rounds)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN c USING (r)"""


#: crc32 goes through each character's code and eight shifts, which -1 stands for.
TRIE = r"""WITH o AS (SELECT conv_id, list(coalesce(role, '') || chr(10) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4 AS h FROM o),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1 : h.h] END, h.own[h.h + 1 :]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS MATERIALIZED (SELECT conv_id, len(t) AS size, d AS depth, t[1:d] AS node FROM r, unnest(range(len(t) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY node, depth),
k AS MATERIALIZED (SELECT n.*, coalesce(c.n_children, 0) AS n_children,
  CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(substr(node[n.depth], instr(node[n.depth], chr(10)) + 1), '[ 	-]+'), lambda w: w <> '')) END AS tokens
  FROM n LEFT JOIN (SELECT node[1 : depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up) c ON c.up = n.node),
s AS (SELECT node[1:d] AS node, sum(tokens) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM k, unnest(range(depth + 1)) AS u(d) GROUP BY 1)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN n p ON k.depth > 0 AND p.node = k.node[1 : k.depth - 1]"""

SIMILAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda w: w <> '') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS sizes FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * common >= 85 * (sizes - common)), l2 AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS far FROM d UNION SELECT r.doc_id, l2.b FROM reach r JOIN l2 ON l2.a = r.far),
f AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM d JOIN f USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op4_chat": _chat(), "op11_vector_codes": _codes(), "op12_prefix_trie": TRIE, "op13_minhash": SIMILAR}
