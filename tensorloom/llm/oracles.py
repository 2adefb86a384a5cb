"""SQL twins of the queries that SQL can state, over the same tables."""

from __future__ import annotations

from tensorloom.llm import chat, embedding_dedup, fill_middle, ngram_join, periodic_runs, secrets, spotsigs

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = f"""array_to_string([substr('{_LETTERS}', 1 + ((('0x' || substr(sha1(h), 5 * (k // 4) + 1, 5))::BIGINT
  >> (15 - 5 * (k % 4))::INTEGER) & 31)::INTEGER, 1) for k in range(32)], '')"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN l USING (h)"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_SHOWN = rf"regexp_replace({{0}}, '{_quoted(chat._ESCAPE.pattern)}', '\1\\\2\3', 'g')"
_FRAME = len(chat.BEGIN + chat.HEAD + chat.TAIL + chat.END)

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  sum({_FRAME} + length({_SHOWN.format("role")}) + length({_SHOWN.format("text")}))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g"""


def _kind(rank: int, kind: str) -> str:
    side, pattern, group, least, weak = secrets.KINDS[kind]
    p = _quoted(pattern)
    also = "".join(f" AND regexp_matches(part, '{m}')" for m in (secrets.MIXED if kind == "mixed" else ()))
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, '{side}' AS side, {str(weak).lower()} AS weak, stop - length(hit) AS start, stop
FROM (SELECT doc_id, hit, part, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap
    FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS parts,
      string_split_regex(text, '{p}') AS gaps FROM d)))
WHERE length(part) >= {least}{also}"""


def _listed(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({where}), '')"


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind(k, kind) for k, kind in enumerate(secrets.KINDS))}),
r AS (SELECT * FROM s WHERE NOT weak OR EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id
  AND (o.side = 'secret') <> (s.side = 'secret') AND o.start - s.stop <= {secrets.REACH} AND s.start - o.stop <= {secrets.REACH}))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in secrets.BASE)},
  sha256({_listed("NOT weak")}) AS base_sha256, {_listed("kind IS NOT NULL")} AS spans,
  count(*) FILTER (weak)::BIGINT AS n_linked
FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


def _components(vertices: str, edges: str) -> str:
    """CTE root(id, root): the least vertex reachable over the edges (u, v), itself included."""
    return f"""reach(id, other) AS (SELECT id, id FROM {vertices}
  UNION SELECT r.id, e.v FROM reach r JOIN {edges} e ON e.u = r.other),
root AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"""


EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND x IS NOT NULL
  AND len([k for k in x if k IS NULL OR NOT isfinite(k)]) = 0 AND len([k for k in x if k <> 0]) > 0),
e AS (SELECT a.id AS u, b.id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.id <> b.id
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= {embedding_dedup.THRESHOLD}::DOUBLE),
{_components("v", "e")}
SELECT v.id AS vec_id, (SELECT count(*) FROM e WHERE e.u = v.id)::BIGINT AS n_links, root AS component_id, v.id = root AS kept
FROM v JOIN root ON root.id = v.id"""

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest([array_to_string(w[k:k + least({ngram_join.WORDS}, len(w)) - 1], ' ')
  for k in range(1, greatest(len(w) - {ngram_join.WORDS - 1}, 1) + 1)]) AS g FROM d WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS own FROM s GROUP BY id),
c AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n a ON a.id = u JOIN n b ON b.id = v WHERE shared / (a.n + b.n - shared)::DOUBLE >= {ngram_join.THRESHOLD}),
{_components("d", "e")}
SELECT d.id AS doc_id, coalesce((SELECT min(o.id) FROM n o WHERE o.own = n.own), d.id) AS copy_id, root AS class_id,
  (SELECT count(*) FROM e WHERE e.u = d.id)::BIGINT AS n_links, d.id = root AS kept
FROM d JOIN root ON root.id = d.id LEFT JOIN n ON n.id = d.id"""

_STOPS = ", ".join(f"'{w}'" for w in spotsigs.ANCHORS)
SPOTSIGS = rf"""WITH o AS (SELECT doc_id, coalesce(text, '') AS text,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM documents),
t AS (SELECT o.doc_id, o.text, o.next_id, substr(o.text, 1, length(o.text) - length(o.text) // 3)
  || substr(x.text, 1, length(o.text) // 3) AS edited FROM o JOIN o x ON x.doc_id = o.next_id),
b AS (SELECT doc_id, 0 AS side, text FROM t UNION ALL SELECT doc_id, 1, edited FROM t),
l AS (SELECT doc_id, side, [x for x in string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') if x <> ''] AS ws
  FROM b),
w AS (SELECT doc_id, side, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM l),
m AS (SELECT *, word IN ({_STOPS}) AS stop, sum((word NOT IN ({_STOPS}))::INTEGER) OVER (PARTITION BY doc_id, side ORDER BY i) AS k FROM w),
c AS (SELECT * FROM m WHERE NOT stop),
spot AS (SELECT a.doc_id, a.side, a.i, q.i AS last, a.word || ' ' || p.word || ' ' || q.word || ' ' AS sig FROM m a
  JOIN c p ON p.doc_id = a.doc_id AND p.side = a.side AND p.k = a.k + 1 AND p.i - a.i - 1 <= {spotsigs.SKIP}
  JOIN c q ON q.doc_id = a.doc_id AND q.side = a.side AND q.k = a.k + 2 AND q.i - p.i - 1 <= {spotsigs.SKIP} WHERE a.stop),
held AS (SELECT DISTINCT doc_id, side, unnest(range(i, last + 1)) AS i FROM spot),
free AS (SELECT w.* FROM w ANTI JOIN held ON held.doc_id = w.doc_id AND held.side = w.side AND held.i = w.i),
pair AS (SELECT a.doc_id, a.side, '=' || a.word || ' ' || b.word || ' ' AS sig FROM free a
    JOIN free b ON b.doc_id = a.doc_id AND b.side = a.side AND b.i = a.i + 1
  UNION ALL SELECT doc_id, side, '= ' || ws[1] || ' ' FROM l WHERE len(ws) = 1),
sig AS (SELECT DISTINCT doc_id, side, substr(md5(sig), 1, 8) AS s FROM spot UNION SELECT DISTINCT doc_id, side, substr(md5(sig), 1, 8) FROM pair),
f AS (SELECT doc_id, side, count(*) AS n, string_agg(s, ',' ORDER BY s) AS shown FROM sig GROUP BY 1, 2),
j AS (SELECT t.doc_id, coalesce(a.n, 0) AS na, coalesce(e.n, 0) AS ne, coalesce(x.n, 0) AS nx, coalesce(a.shown, '') AS fp,
  coalesce(e.shown, '') AS efp, t.text, t.edited, t.next_id FROM t
  LEFT JOIN f a ON a.doc_id = t.doc_id AND a.side = 0 LEFT JOIN f e ON e.doc_id = t.doc_id AND e.side = 1
  LEFT JOIN f x ON x.doc_id = t.next_id AND x.side = 0),
be AS (SELECT a.doc_id, count(*) AS k FROM sig a JOIN sig e ON e.doc_id = a.doc_id AND e.s = a.s AND e.side = 1 WHERE a.side = 0 GROUP BY 1),
bx AS (SELECT a.doc_id, count(*) AS k FROM t JOIN sig a ON a.doc_id = t.doc_id AND a.side = 0
  JOIN sig x ON x.doc_id = t.next_id AND x.side = 0 AND x.s = a.s GROUP BY 1)
SELECT j.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
  CASE WHEN na = 0 AND ne = 0 THEN 1.0 ELSE coalesce(be.k, 0) / (na + ne - coalesce(be.k, 0))::DOUBLE END::DOUBLE AS near_edited,
  CASE WHEN na = 0 AND nx = 0 THEN 1.0 ELSE coalesce(bx.k, 0) / (na + nx - coalesce(bx.k, 0))::DOUBLE END::DOUBLE AS near_next,
  floor(ln(greatest(na, 1)::DOUBLE) / -ln(0.8::DOUBLE) + 1e-9::DOUBLE)::INTEGER AS size_class
FROM j LEFT JOIN be ON be.doc_id = j.doc_id LEFT JOIN bx ON bx.doc_id = j.doc_id"""

# CRC-32 bit by bit: each character and seven zeros, one shift for each of the eight
_CRC32 = """xor(list_reduce(flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[] for c in string_split(coalesce(doc_id::VARCHAR, ''), '') if c <> '']),
  lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1)), 4294967295), 4294967295)"""
_LEAST = periodic_runs.LEAST
_HALF = _LEAST // 2  # words q apart that are equal in a row, in any run

RUNS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32}::BIGINT AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
e AS (SELECT doc_id, n, a, 1 + (n - a) // (3 + g % 8) AS p, w FROM a),
x AS (SELECT doc_id, n, CASE WHEN a = n THEN w ELSE [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(n)] END AS w FROM e),
k AS (SELECT doc_id, unnest(range(greatest(n - {_HALF - 1}, 0))) AS i, unnest([array_to_string(w[j + 1:j + {_HALF}], ' ')
  for j in range(greatest(n - {_HALF - 1}, 0))]) AS s FROM x),
m AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM k u JOIN k v ON u.doc_id = v.doc_id AND u.s = v.s AND u.i < v.i),
c AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM m),
f AS (SELECT doc_id, q, min(i) AS start, count(*) + {_HALF - 1} AS chain FROM c GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, chain + q AS length, min(q) AS period FROM f WHERE chain >= q AND chain + q >= {_LEAST} GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
z AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM x),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM z
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = z.doc_id AND z.i >= r.start + r.period AND z.i < r.start + r.length) GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN b ON b.doc_id = x.doc_id LEFT JOIN o ON o.doc_id = x.doc_id"""

_P, _S, _M = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{fill_middle.UNIT}') AS u, [('0x' || substr(s, 8 * k + 1, 8))::BIGINT for k in range(4)] AS h FROM d),
n AS (SELECT *, len(u)::BIGINT AS n FROM w),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle
    ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
