"""DuckDB SQL for the rows of the training-data queries that SQL can express.

op2 takes absolute and root-relative link targets; op3 works on hexadecimal text, two characters a byte.
"""

_HOST = "translate(coalesce(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_ADDRESS = (
    "CASE WHEN contains({u}, '://') THEN " + _HOST + " || CASE WHEN regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') LIKE '/%' THEN '' ELSE '/' END"
    " || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
)
_RULES = "(VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, h, p)"


def _judged(host: str, path: str) -> str:
    return (
        f"(SELECT max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) FROM {_RULES} "
        f"WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p))"
    )


OP2 = f"""
WITH RECURSIVE named AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(coalesce(html, ''), '<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(coalesce(html, ''), '<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1, 'is')
  ]) AS t FROM pages WHERE url IS NOT NULL
), pointed AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN t LIKE '//%' THEN 'http:' || t
    WHEN t LIKE '/%' THEN regexp_extract(url, '^(.*?://)', 1, 's') || {_HOST.format(u='url')} || t END AS target
  FROM named WHERE t <> ''
), edge AS (
  SELECT DISTINCT {_ADDRESS.format(u='url')} AS a, {_ADDRESS.format(u='target')} AS b FROM pointed
), both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), page AS (
  SELECT page_id, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path, {_ADDRESS.format(u='url')} AS node FROM pages
), judged AS (SELECT *, {_judged('host', 'path')} AS j FROM page
), member AS (
  SELECT node, j.verdict AS v FROM judged WHERE j IS NOT NULL UNION
  SELECT node, {_judged("regexp_extract(node, '^[^/?#]*', 0)", "regexp_extract(node, '^[^/?#]*([^?#]*)', 1, 's')")}.verdict FROM (SELECT DISTINCT node FROM reach)
), class AS (
  SELECT r.node, bool_or(m.v = 'allow') AS allowed, bool_or(m.v = 'block') AS blocked FROM reach r JOIN member m ON m.node = r.other GROUP BY 1
)
SELECT page_id, host, path, j.rule AS rule,
  coalesce(j.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN class USING (node)
"""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE doc_id IS NOT NULL GROUP BY s),
g AS (SELECT r, i, i + 50 AS e FROM w JOIN f USING (s) WHERE first < doc_id),
m AS (SELECT r, i, e, CASE WHEN i <= max(e) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT r, i, e, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
s AS (SELECT r, run, min(i) AS a, max(e) AS b FROM n GROUP BY 1, 2),
k AS (
  SELECT d.r, d.doc_id, h, coalesce(list(s.a ORDER BY s.a) FILTER (s.a IS NOT NULL), []) AS a, coalesce(list(s.b ORDER BY s.a) FILTER (s.a IS NOT NULL), []) AS b
  FROM d LEFT JOIN s USING (r) GROUP BY ALL
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes,
  coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda x: b[x] - a[x])), 0)::BIGINT AS n_removed, len(a)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda x:
    substr(h, CASE WHEN x = 1 THEN 1 ELSE 2 * b[x - 1] + 1 END, CASE WHEN x > len(a) THEN length(h) ELSE 2 * a[x] END - CASE WHEN x = 1 THEN 0 ELSE 2 * b[x - 1] END)), ''))) AS kept_sha256
FROM k
"""

OP7 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, len(list_filter(range(1, len(q.c) + 1), lambda i: q.c[i] <> v.c[i]))::INT AS distance
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q, v
)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p
) WHERE rank <= 10
"""

_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, order: int, pattern: str, value: str, keep: str) -> str:
    return f"""
  SELECT r, o, p, '{kind}' AS kind, {order} AS ord, e - length(m) AS s, CASE WHEN '{kind}' = 'owned' THEN e - length(m) + length(v) ELSE e END AS e, v FROM (
    SELECT r, o, p, ms[i] AS m, {value} AS v,
      list_sum(list_transform(ss[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS e
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, o, p, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ss, regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0}) AS gs FROM d
    )) ) WHERE {keep}"""


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS p FROM documents),
x AS (
  {_spans('assign', 0, _ASSIGN, 'gs[i]', 'length(v) >= 12')} UNION ALL
  {_spans('access', 1, 'AKIA[A-Z0-9]{14,}', 'ms[i]', 'true')} UNION ALL
  {_spans('hex', 2, '[0-9a-f]{16,}', 'ms[i]', 'true')} UNION ALL
  {_spans('owned', 3, '[A-Za-z0-9+/_.=-]{24,}', "regexp_extract(ms[i], '^[A-Za-z0-9+/_-]*')", "length(v) >= 24 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')")}
),
h AS (SELECT v, count(DISTINCT o) <= 1 AND count(DISTINCT (o, p)) <= 3 AS live FROM x GROUP BY v),
y AS (SELECT x.*, live FROM x JOIN h USING (v)),
k AS (
  SELECT * FROM y WHERE ord < 3 UNION ALL
  SELECT y.* FROM y WHERE ord = 3 AND live AND NOT EXISTS (SELECT 1 FROM x b WHERE b.r = y.r AND b.ord < 3 AND b.s < y.e AND y.s < b.e)
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord), '') AS spans, count(*) FILTER (live) AS n_live
FROM d LEFT JOIN k USING (r) GROUP BY d.r, doc_id
"""

OP12 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM (SELECT * FROM r WHERE id % 100 = 0) a JOIN r b ON a.id <> b.id
), g AS (
  SELECT anchor_id, id AS positive_id, s AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5
)
SELECT g.anchor_id, positive_id, (row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY s DESC, id))::INT AS rank,
  id AS negative_id, positive_score, s AS negative_score
FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT same AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score
QUALIFY rank <= 5
"""

OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

SQL = {"op2_redirect_urls": OP2, "op3_radix_repeats": OP3, "op7_hashing_search": OP7, "op9_ownership_secrets": OP9, "op12_angular_negatives": OP12, "op13_middle_rotation": OP13}
