"""The registered queries again, as SQL for an independent engine on the same tables."""

from __future__ import annotations

from groundwell.config import Settings
from groundwell.operators.headings import FRONT_MATTER, KNOWN_SECTION, PAGE_MARKER, PAGE_NUMBER
from groundwell.operators.intent import ADVICE_RULES, EMERGENCY_RULES
from groundwell.operators.output_gate import FRAMING_PHRASES
from groundwell.operators.rewrite import AMBIGUOUS, GLOSSARY
from groundwell.operators.wording import REFUSALS
from groundwell.functions.text import CONFUSIONS

S = Settings()
TOKEN_UNIT = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"
SQL: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:-[a-z0-9]+)*')"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(TOKEN_UNIT)}))"


def sents(x: str) -> str:
    cut = (
        rf"regexp_replace(regexp_replace({x}, '([.!?:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g')"
    )
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def share(part: str, whole: str) -> str:
    return (
        f"(CASE WHEN len({part}) > 0 THEN len(list_intersect({part}, {whole})) * 1.0::DOUBLE / len({part}) ELSE 0.0 END)"
    )


def numbers(x: str) -> str:
    """Grouping commas go one at a time, since the engine has no look-around."""
    plain = rf"regexp_replace(regexp_replace({x}, '([0-9]),([0-9]{{2,3}}\b)', '\1\2', 'g'), '([0-9]),([0-9]{{2,3}}\b)', '\1\2', 'g')"
    return (
        f"list_distinct(list_transform(regexp_extract_all({plain}, '[0-9]+(?:\\.[0-9]+)?'), "
        "lambda n: coalesce(nullif(ltrim(n, '0'), ''), '0')))"
    )


# --- text ---------------------------------------------------------------------------------------

SQL["token_stats"] = f"""
SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, len(list_distinct({toks('text')}))::BIGINT AS n_distinct
FROM documents"""

SQL["sentence_split"] = f"""
WITH s AS (SELECT doc_id, {sents('text')} AS l FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS r(i)"""

SQL["number_extract"] = f"""
SELECT doc_id, array_to_string(list_sort({numbers('text')}), '|') AS numbers FROM documents"""

SQL["marker_strip"] = r"""
WITH m AS (SELECT conv_id, turn,
  '1. ' || text || ' [C' || (turn + 1) || ', C2]. 2) ' || role || ' [X1]' AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\[(?:C[0-9]+)(?:\s*,\s*C[0-9]+)*\]', ' ', 'g'),
  '(?m)(^|[.!?]\s+)[0-9]+[.)]\s', '\1 ', 'g') AS plain FROM m"""


def _clean(x: str) -> str:
    for wrong, right in CONFUSIONS:
        x = f"replace({x}, {lit(wrong)}, {lit(right)})"
    x = rf"regexp_replace({x}, '[\x{{2e80}}-\x{{9fff}}\x{{ac00}}-\x{{d7ff}}\x{{ff00}}-\x{{ffef}}]', '', 'g')"
    x = rf"regexp_replace({x}, '\s+([,;:)%])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([(])\s+', '\1', 'g')"
    return strip(rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')")


SQL["recognised_clean"] = f"""
WITH n AS (SELECT doc_id, replace(text, ',', ' ，') || ' ( grade 三 ) 丁 “x” ％' AS t FROM documents)
SELECT doc_id, {_clean('t')} AS cleaned FROM n"""

SQL["question_tidy"] = r"""
SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS tidy FROM conversations"""

SQL["cache_key"] = """
SELECT doc_id, substr(sha256(lang || '|' || text), 1, 32) AS key,
  sha256('text-embedding-3-large|3072|' || text) AS embedding_key FROM documents"""

SQL["account_keys"] = rf"""
WITH e AS (SELECT c_custkey, c_nationkey, lower({strip(
    "' ' || regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g') || '@' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.COM ' END"
)}) AS email FROM customer)
SELECT c_custkey, email,
  length(email) BETWEEN 1 AND 254 AND regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$') AS valid,
  substr(sha256(c_custkey || '|{S.fingerprint}'), 1, 24) AS subject,
  CASE WHEN c_custkey % 2 = 0 THEN '10.0.' || c_nationkey || '.1' ELSE '127.0.0.1' END AS address FROM e"""

ISO = "strftime(date_trunc('millisecond', {}), '%Y-%m-%dT%H:%M:%S.%g+00:00')"

SQL["iso_round_trip"] = f"""
SELECT event_id, {ISO.format('ts')} AS iso, epoch_us(ts) // 1000 AS epoch_ms,
  floor(epoch_us(ts) // 1000000 / 3600)::BIGINT AS "window" FROM events"""

# --- structure ----------------------------------------------------------------------------------

_LINES = f"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
alll AS (SELECT doc_id, i, {strip('l[i]')} AS text FROM raw, unnest(range(1, len(l) + 1)) AS r(i)),
nearby AS (SELECT *, coalesce(lag(text) OVER w, '') = '' AS prev_blank, coalesce(lead(text) OVER w, '') = '' AS next_blank
  FROM alll WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, text, prev_blank, next_blank,
    regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 1) AS num,
    regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 2) AS title,
    length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters
  FROM nearby WHERE text <> '' AND NOT regexp_matches(text, {lit(PAGE_MARKER)})),
levelled AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no, text,
  (CASE WHEN length(text) > 110 THEN 0
    WHEN regexp_matches(text, '^(#{{1,6}})\\s+(.+?)\\s*#*$') THEN length(regexp_extract(text, '^(#{{1,6}})\\s+(.+?)\\s*#*$', 1))
    WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '^\\p{{L}}$'))) >= 2 THEN 0
    WHEN num <> '' AND length(text) <= 90 AND NOT right(text, 1) IN ('.', ';', ',')
      AND len(regexp_extract_all(title, '\\S+')) <= 9 AND length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) >= 3
      AND NOT regexp_matches(title, '[.!?]\\s+\\S') THEN least(6, length(num) - length(replace(num, '.', '')) + 1)
    WHEN regexp_matches(text, '^[^a-z]*[A-Z][^a-z]{{2,}}$') AND length(text) BETWEEN 3 AND 80 AND n_letters >= 4 THEN 1
    WHEN prev_blank AND next_blank AND length(text) <= 70 AND NOT right(text, 1) IN ('.', ';', ',', ':')
      AND regexp_matches(text, '^\\p{{Lu}}') AND n_letters >= 4 THEN 2
    ELSE 0 END)::INT AS level FROM seen)"""

SQL["heading_levels"] = f"WITH {_LINES} SELECT doc_id, line_no, text, level FROM levelled"

_PATH = """coalesce(nullif(array_to_string(list_slice(t, -4, -1), ' > '), ''), 'Body')"""

_SECTIONS = f"""{_LINES},
heads AS (SELECT doc_id, line_no, level, CASE WHEN regexp_matches(text, '^(#{{1,6}})\\s+(.+?)\\s*#*$')
    THEN {strip("regexp_extract(text, '^(#{1,6})\\s+(.+?)\\s*#*$', 2)")}
    ELSE {strip("regexp_replace(text, ':+$', '')")} END AS title FROM levelled WHERE level > 0),
chain AS (SELECT h.doc_id, h.line_no, g.line_no AS place, g.title FROM heads h JOIN heads g
    ON g.doc_id = h.doc_id AND g.line_no <= h.line_no
    WHERE NOT EXISTS (SELECT 1 FROM heads m WHERE m.doc_id = h.doc_id AND m.line_no > g.line_no
      AND m.line_no <= h.line_no AND m.level <= g.level)),
paths AS (SELECT doc_id, line_no, count(*)::INT AS depth,
    list(title ORDER BY place) FILTER (NOT regexp_matches(title, {lit(FRONT_MATTER)})) AS t FROM chain GROUP BY ALL),
headed AS (SELECT p.doc_id, p.line_no, {_PATH} AS path, depth, regexp_matches(h.title, {lit(FRONT_MATTER)}) AS front
    FROM paths p JOIN heads h USING (doc_id, line_no)),
owned AS (SELECT l.doc_id, l.line_no, l.text, coalesce(max(CASE WHEN level > 0 THEN l.line_no END)
    OVER (PARTITION BY l.doc_id ORDER BY l.line_no), -1) AS head, level FROM levelled l),
bodies AS (SELECT doc_id, head, string_agg(text, chr(10) ORDER BY line_no) AS text FROM owned WHERE level = 0 GROUP BY ALL),
sections AS (SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY b.head) - 1)::INT AS seq,
    coalesce(h.path, 'Body') AS path, 0 AS page_start, 0 AS page_end, b.text, coalesce(h.depth, 0)::INT AS heading_level
    FROM bodies b LEFT JOIN headed h ON h.doc_id = b.doc_id AND h.line_no = b.head WHERE NOT coalesce(h.front, false))"""

SQL["text_sections"] = f"WITH {_SECTIONS} SELECT * FROM sections"

SQL["text_layer"] = f"""
WITH {_SECTIONS}, n AS (SELECT doc_id, sum(length(text)) AS c FROM levelled GROUP BY 1),
s AS (SELECT DISTINCT doc_id FROM sections)
SELECT d.doc_id, 1 AS n_pages,
  greatest(coalesce(n.c, 0), CASE WHEN s.doc_id IS NOT NULL THEN 100 ELSE 0 END)::INT AS n_chars,
  greatest(coalesce(n.c, 0), CASE WHEN s.doc_id IS NOT NULL THEN 100 ELSE 0 END) >= 100 AS readable
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id) WHERE d.text IS NOT NULL"""

_TYPESET = f"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
alll AS (SELECT doc_id, (i - 1)::BIGINT AS line_no, {strip('l[i]')} AS text FROM raw, unnest(range(1, len(l) + 1)) AS r(i)),
lines AS (SELECT doc_id, line_no, text, (line_no // 8 + 1)::INT AS page,
  CASE WHEN length(text) % 7 = 0 THEN 14.0 WHEN length(text) % 5 = 0 THEN 12.0 WHEN length(text) % 3 = 0 THEN 11.0
    ELSE 10.0 END::DOUBLE AS size,
  length(text) % 2 = 0 AS bold, CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 3 END AS block_lines
  FROM alll WHERE text <> ''),
sizes AS (SELECT doc_id, size, sum(length(text)) AS c, min(line_no) AS f FROM lines GROUP BY ALL),
body AS (SELECT doc_id, size AS body FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1)"""

SQL["body_size"] = f"WITH {_TYPESET} SELECT doc_id, body FROM body"

SQL["furniture_lines"] = f"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
k AS (SELECT DISTINCT source, doc_id, lower({strip('text')}) AS furniture FROM l),
n AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY 1)
SELECT source, furniture, count(*) AS n_docs FROM k JOIN n USING (source) WHERE furniture <> ''
GROUP BY source, furniture, n_pages
HAVING n_pages >= 3 AND count(*) >= greatest(2, floor(n_pages * 0.05))"""

_HEADED = f"""{_TYPESET},
np AS (SELECT doc_id, max(page) AS n_pages FROM lines GROUP BY 1),
furn AS (SELECT doc_id, lower(text) AS k FROM lines JOIN np USING (doc_id) GROUP BY doc_id, lower(text), n_pages
  HAVING n_pages >= 3 AND count(DISTINCT page) >= greatest(3, floor(n_pages * 0.4))),
cont AS (SELECT l.*, b.body, np.n_pages FROM lines l JOIN body b USING (doc_id) JOIN np USING (doc_id)
  WHERE NOT regexp_matches(l.text, {lit(PAGE_NUMBER)})
    AND NOT EXISTS (SELECT 1 FROM furn f WHERE f.doc_id = l.doc_id AND f.k = lower(l.text))),
flag AS (SELECT *, n_pages > 4 AND page <= 1 AS on_cover,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) = 1 AS leads,
    NOT (n_pages > 4 AND page <= 1) AND length(text) <= 120 AND NOT right(text, 1) IN ('.', ';', ',')
    AND (size >= body * 1.12 OR regexp_matches(text, {lit(KNOWN_SECTION)})
      OR (bold AND block_lines = 1 AND length(text) <= 80 AND size >= body * 0.98)) AS is_heading FROM cont),
headed AS (SELECT *, is_heading AND leads AND size >= body * 1.15 AS resets,
  sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section FROM flag)"""

SQL["typeset_headings"] = f"WITH {_HEADED} SELECT doc_id, line_no, is_heading, resets, on_cover, section FROM headed"

_RAW_SECTIONS = f"""{_HEADED},
hs AS (SELECT doc_id, section, size, resets, page, {strip("regexp_replace(text, ':+$', '')")} AS title
  FROM headed WHERE is_heading),
chain AS (SELECT h.doc_id, h.section, g.section AS place, g.title FROM hs h JOIN hs g
  ON g.doc_id = h.doc_id AND g.section <= h.section
  WHERE NOT EXISTS (SELECT 1 FROM hs m WHERE m.doc_id = h.doc_id AND m.section > g.section
    AND m.section <= h.section AND (m.size >= g.size OR m.resets))),
paths AS (SELECT doc_id, section, count(*)::INT AS depth,
  list(title ORDER BY place) FILTER (NOT regexp_matches(title, {lit(FRONT_MATTER)})) AS t FROM chain GROUP BY ALL),
bodies AS (SELECT doc_id, section, {strip("string_agg(text, chr(10) ORDER BY line_no)")} AS text,
  min(page) AS first_page, max_by(page, line_no) AS page_end, bool_or(on_cover) AS cover
  FROM headed WHERE NOT is_heading GROUP BY ALL),
rawsec AS (SELECT b.doc_id, b.section,
  CASE WHEN p.doc_id IS NULL THEN CASE WHEN b.cover THEN 'Front cover' ELSE 'Preamble' END ELSE {_PATH} END AS path,
  coalesce(h.page, b.first_page)::INT AS page_start, b.page_end::INT AS page_end, b.text,
  coalesce(p.depth, 0)::INT AS heading_level, coalesce(regexp_matches(h.title, {lit(FRONT_MATTER)}), false) AS front
  FROM bodies b LEFT JOIN paths p USING (doc_id, section) LEFT JOIN hs h USING (doc_id, section) WHERE b.text <> '')"""

SQL["typeset_sections"] = f"WITH {_RAW_SECTIONS} SELECT * FROM rawsec"

_PARENT = "CASE WHEN contains({0}, ' > ') THEN regexp_extract({0}, '(?s)^(.*) > ', 1) ELSE {0} END"

_FOLDED = f"""{_RAW_SECTIONS},
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS o FROM rawsec WHERE NOT front),
fold AS (
  SELECT doc_id, o, section, 0::BIGINT AS grp, path AS now FROM ord WHERE o = 1
  UNION ALL
  SELECT r.doc_id, r.o, r.section, f.grp + (NOT j.joins)::INT, CASE WHEN j.joins THEN {_PARENT.format('r.path')} ELSE r.path END
  FROM fold f JOIN ord r ON r.doc_id = f.doc_id AND r.o = f.o + 1,
    LATERAL (SELECT length(r.text) < 200 AND contains(r.path, ' > ')
      AND {_PARENT.format('r.path')} = {_PARENT.format('f.now')} AS joins) j),
folded AS (SELECT doc_id, grp::INT AS seq, max_by(now, f.o) AS path, min_by(page_start, f.o) AS page_start, max(page_end) AS page_end,
  string_agg(CASE WHEN first THEN text ELSE regexp_replace(path, '(?s)^.* > ', '') || ': ' || text END, chr(10) ORDER BY f.o) AS text
FROM (SELECT f.*, r.path, r.page_start, r.page_end, r.text,
    row_number() OVER (PARTITION BY f.doc_id, grp ORDER BY f.o) = 1 AS first
  FROM fold f JOIN ord r ON r.doc_id = f.doc_id AND r.o = f.o) f GROUP BY doc_id, grp)"""

SQL["typeset_folded"] = f"WITH RECURSIVE {_FOLDED} SELECT * FROM folded"

SQL["scan_titles"] = rf"""
WITH t AS (SELECT doc_id, source, list_filter(list_transform(list_slice(regexp_split_to_array(text, '\r\n|\n|\r'), 1, 40),
    lambda x: {strip("regexp_replace(" + strip('x') + ", '^#+', '')")}),
    lambda x: length(x) BETWEEN 8 AND 130 AND len(list_filter(regexp_split_to_array(x, '\s+'),
      lambda w: regexp_matches(w, '^\p{{L}}+$'))) >= 2)[1] AS t,
  regexp_replace(source, '[_-]', ' ', 'g') || ' part ' || doc_id AS stem FROM documents)
SELECT doc_id, CASE WHEN t IS NULL THEN upper(stem[1]) || lower(substr(replace(stem, 'part', 'Part'), 2, position(' ' IN stem) - 1)) || 'Part ' || doc_id
  WHEN t = upper(t) THEN array_to_string(list_transform(regexp_extract_all(t, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(substr(w, 2))), '')
  ELSE t END AS title,
  'the-' || source || '-no-' || doc_id AS slug FROM t"""

# --- chunks -------------------------------------------------------------------------------------


def pack(src: str) -> str:
    """Pieces of `src` (key, seq, text) as `kept` (key, seq, piece, text, n_tokens). Needs WITH RECURSIVE."""
    return f"""
sl AS (SELECT key, seq, {sents('text')} AS l FROM {src}),
se AS (SELECT key, seq, i - 1 AS i, l[i] AS s, {n_tokens('l[i]')} AS n FROM sl, unnest(range(1, len(l) + 1)) AS r(i)),
pf AS (SELECT *, sum(n) OVER (PARTITION BY key, seq ORDER BY i) - n AS p FROM se),
tl AS (SELECT a.*, (SELECT min(b.i) FROM pf b WHERE b.key = a.key AND b.seq = a.seq AND b.i <= a.i AND a.p - b.p <= 48) AS t FROM pf a),
walk AS (
  SELECT DISTINCT key, seq, 0::BIGINT AS i, 0::BIGINT AS o, NULL::BIGINT AS b, NULL::BIGINT AS e FROM tl
  UNION ALL
  SELECT w.key, w.seq, w.i + 1,
    CASE WHEN w.o = w.i AND x.n > 320 THEN w.i + 1 WHEN w.o < w.i AND x.p - y.p + x.n > 320 THEN greatest(w.o, x.t) ELSE w.o END,
    CASE WHEN (w.o = w.i AND x.n > 320) OR (w.o < w.i AND x.p - y.p + x.n > 320) THEN w.o END,
    CASE WHEN w.o = w.i AND x.n > 320 THEN w.i + 1 WHEN w.o < w.i AND x.p - y.p + x.n > 320 THEN w.i END
  FROM walk w JOIN tl x ON x.key = w.key AND x.seq = w.seq AND x.i = w.i
    JOIN tl y ON y.key = w.key AND y.seq = w.seq AND y.i = w.o),
ends AS (SELECT key, seq, max(i) AS i FROM walk GROUP BY ALL),
spans AS (SELECT key, seq, i, b, e FROM walk WHERE b IS NOT NULL
  UNION ALL SELECT w.key, w.seq, w.i + 1, w.o, w.i FROM walk w JOIN ends USING (key, seq, i) WHERE w.o < w.i),
pieces AS (SELECT key, seq, row_number() OVER (PARTITION BY key, seq ORDER BY s.i) - 1 AS piece, b, e FROM spans s),
texts AS (SELECT p.key, p.seq, p.piece, string_agg(t.s, ' ' ORDER BY t.i) AS text FROM pieces p
  JOIN tl t ON t.key = p.key AND t.seq = p.seq AND t.i >= p.b AND t.i < p.e GROUP BY ALL),
tagged AS (SELECT *, max(piece) OVER (PARTITION BY key, seq) AS last, {n_tokens('text')} AS n FROM texts),
tails AS (SELECT key, seq, piece, text FROM tagged WHERE piece = last AND last > 0 AND n < 60),
joined AS (SELECT g.key, g.seq, g.piece, CASE WHEN t.text IS NULL THEN g.text ELSE g.text || ' ' || t.text END AS text
  FROM tagged g LEFT JOIN tails t ON t.key = g.key AND t.seq = g.seq AND t.piece = g.piece + 1
  WHERE NOT EXISTS (SELECT 1 FROM tails x WHERE x.key = g.key AND x.seq = g.seq AND x.piece = g.piece)),
kept AS (SELECT key, seq, piece::INT AS piece, text, {n_tokens('text')}::INT AS n_tokens,
    printf('%s::%04d::%02d', key::VARCHAR, seq, piece) AS chunk_id FROM joined WHERE {n_tokens('text')} >= 10)"""


SQL["chunk_pack"] = f"""
WITH RECURSIVE src AS (SELECT doc_id AS key, 0 AS seq, text FROM documents), {pack('src')}
SELECT chunk_id, key AS doc_id, n_tokens, text FROM kept"""

_CHUNKS = f"""{_SECTIONS}, src AS (SELECT doc_id AS key, seq, text FROM sections), {pack('src')},
chunks AS (SELECT chunk_id, key AS doc_id, k.seq, piece, s.path, n_tokens, k.text
  FROM kept k JOIN sections s ON s.doc_id = k.key AND s.seq = k.seq)"""

SQL["chunk_sections"] = f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks"

SQL["chunk_records"] = f"""
WITH RECURSIVE {_CHUNKS}, a AS (SELECT doc_id, upper(source[1]) || source[2:] AS title, source, lang FROM documents)
SELECT chunk_id, title, 'file:/' || source AS source_url, lang AS specialty, path AS section_path, 0 AS page_start, n_tokens,
  NULL::VARCHAR AS doc_version, 'v1' AS index_version,
  sha256(title || ' — ' || path || chr(10) || chr(10) || text) AS embedded
FROM chunks JOIN a USING (doc_id)"""

SQL["ingest_report"] = f"""
WITH RECURSIVE {_CHUNKS}, n AS (SELECT doc_id, count(*) AS sections FROM sections GROUP BY 1),
c AS (SELECT doc_id, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens FROM chunks GROUP BY 1)
SELECT doc_id, sections, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens, round(tokens / chunks, 6) AS mean_tokens FROM n LEFT JOIN c USING (doc_id)"""

SQL["ingest_skipped"] = f"""
WITH RECURSIVE {_CHUNKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)"""

_CASED = r"array_to_string(list_transform(regexp_extract_all({0}, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(substr(w, 2))), '')"

SQL["cover_titles"] = rf"""
WITH {_TYPESET}, shown AS (SELECT *, max(size) OVER (PARTITION BY doc_id, page) AS largest FROM lines WHERE page <= 3),
large AS (SELECT doc_id, page, line_no, regexp_replace(text, '\s+', ' ', 'g') AS text FROM shown WHERE size >= largest * 0.95
  AND NOT regexp_matches(text, '(?i)^(page\s*(no\.?|\d+)|contents?|index|topics?|s\.?l?\.?\s*no\.?|table of contents|chapter\s*\d*|\d+)\.?$')),
t AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_no) AS t FROM large GROUP BY ALL),
c AS (SELECT doc_id, min_by(t, page) AS t FROM t WHERE length(t) BETWEEN 8 AND 130
  AND len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '\p{{L}}'))) >= 2 GROUP BY 1),
f AS (SELECT doc_id, replace(replace(source || '_part-' || doc_id, '_', ' '), '-', ' ') AS name, CASE WHEN doc_id % 3 = 1 THEN source || ' collection ' || lang END AS kept FROM documents)
SELECT doc_id, CASE WHEN t = upper(t) THEN {_CASED.format('t')} WHEN t IS NOT NULL THEN t WHEN kept IS NOT NULL THEN kept ELSE {_CASED.format('name')} END AS title
FROM f LEFT JOIN c USING (doc_id)"""

_READ = _FOLDED.replace("FROM alll WHERE text <> ''", "FROM alll WHERE text <> '' AND doc_id % 13 <> 0").replace(
    "np AS (SELECT doc_id, max(page) AS n_pages FROM lines GROUP BY 1)",
    "np AS (SELECT doc_id, (len(string_split(coalesce(text, ''), chr(10))) - 1) // 8 + 1 AS n_pages FROM documents)")

SQL["typeset_ingest"] = f"""
WITH RECURSIVE {_READ},
chars AS (SELECT doc_id, coalesce(sum(length(text)), 0) / any_value(n_pages) >= 100 AS readable
  FROM np LEFT JOIN lines USING (doc_id) GROUP BY doc_id),
taken AS (SELECT f.* FROM folded f JOIN chars USING (doc_id) WHERE readable),
src AS (SELECT doc_id AS key, seq, text FROM taken), {pack('src')},
n AS (SELECT doc_id, count(*) AS sections FROM taken GROUP BY 1),
c AS (SELECT key AS doc_id, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens FROM kept GROUP BY 1)
SELECT doc_id, sections, CASE WHEN sections IS NOT NULL THEN coalesce(chunks, 0) END AS chunks,
  CASE WHEN sections IS NOT NULL THEN coalesce(tokens, 0) END AS tokens,
  CASE WHEN NOT readable THEN 'no text layer' WHEN chunks IS NULL THEN 'no chunks' END AS skipped
FROM chars LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

SQL["index_refresh"] = """
SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 10 IN (3, 5) THEN 'embedded' ELSE 'kept' END AS status
FROM documents WHERE doc_id % 10 <> 4"""

# --- retrieval ----------------------------------------------------------------------------------


def bm25(docs: str, asked: str, k: int) -> str:
    """`hits` (qid, doc_id, score, rank) over docs (doc_id, text) for asked (qid, text)."""
    return f"""
tk AS (SELECT doc_id, unnest({toks('text')}) AS term FROM {docs}),
post AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM {docs}) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM {docs}) AS mean),
voc AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM voc) ELSE r END AS idf FROM voc),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({toks('text')}) AS term FROM {asked}) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
hits AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank
  FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


_ASKED = "asked AS (SELECT item_id AS qid, text FROM benchmark)"
_LEX = f"{_ASKED}, {bm25('documents', 'asked', S.retrieve_k)}"
_LEX_WIDE = f"{_ASKED}, {bm25('documents', 'asked', S.corrective_k)}"

SQL["corpus_idf"] = f"WITH {_LEX} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["bm25_topk"] = f"WITH {_LEX} SELECT * FROM hits"

_UNITS = """
comp AS (SELECT vec_id, label, (i - 1)::INT AS pos, embedding[i]::DOUBLE AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)),
len2 AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM comp GROUP BY 1),
units AS (SELECT vec_id, label, pos, CASE WHEN n = 0 THEN x ELSE x / n END AS x FROM comp JOIN len2 USING (vec_id)),
means AS (SELECT label, pos, avg(x) AS x FROM units GROUP BY ALL)"""

SQL["unit_vectors"] = f"WITH {_UNITS} SELECT vec_id, pos, round(x, 6) + 0.0 AS x FROM units"
SQL["vector_mean_by_label"] = f"WITH {_UNITS} SELECT label, pos, round(x, 6) + 0.0 AS x FROM means"


def cosine(asked: str, k: int, stored: str = "(SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)") -> str:
    """`near` (qid, doc_id, distance, rank) for asked (qid, v)."""
    return f"""
near AS (SELECT qid, doc_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id)::INT AS rank
  FROM (SELECT q.qid, s.doc_id, round(1 - list_cosine_similarity(q.v, s.v), 6) + 0.0 AS distance FROM {asked} q, {stored} s)
  QUALIFY rank <= {k})"""


_MEANS = f"{_UNITS}, mv AS (SELECT label, list(x ORDER BY pos) AS v FROM means GROUP BY 1)"

SQL["cosine_topk"] = f"""
WITH {_MEANS}, asked AS (SELECT label AS qid, v FROM mv), {cosine('asked', S.retrieve_k)} SELECT * FROM near"""

_LATER = "(SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5)"
SQL["cosine_filtered"] = f"""
WITH {_MEANS}, asked AS (SELECT label AS qid, v FROM mv), {cosine('asked', S.retrieve_k, _LATER)} SELECT * FROM near"""

SQL["blend_topk"] = f"""
WITH {_MEANS}, ml AS (SELECT label, sqrt(sum(x * x)) AS n FROM means GROUP BY 1),
um AS (SELECT label, pos, x / n AS x FROM means JOIN ml USING (label)),
mixed AS (SELECT a.label, a.pos, CASE WHEN b.label IS NULL THEN a.x ELSE 0.2 * a.x + 0.8 * b.x END AS x
  FROM um a LEFT JOIN um b ON b.label = a.label + 1 AND b.pos = a.pos),
asked AS (SELECT label AS qid, list(x ORDER BY pos) AS v FROM mixed GROUP BY 1),
{cosine('asked', S.retrieve_k)} SELECT * FROM near"""

_SUPPLIERS = """
per AS (SELECT l_suppkey AS qid, l_partkey AS doc_id, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY ALL),
rq AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY q DESC, doc_id) AS rank FROM per QUALIFY rank <= 20),
rp AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY p DESC, doc_id) AS rank FROM per QUALIFY rank <= 20)"""

SQL["rrf_fuse"] = f"""
WITH {_SUPPLIERS} SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused
FROM (SELECT * FROM rq UNION ALL SELECT * FROM rp) GROUP BY ALL"""
SQL["rrf_weighted"] = f"""
WITH {_SUPPLIERS} SELECT qid, doc_id, round(sum(w / (10 + rank)), 12) AS fused
FROM (SELECT *, 1.0::DOUBLE AS w FROM rq UNION ALL SELECT *, 0.5::DOUBLE FROM rp) GROUP BY ALL"""

_DENSE = f"""{_ASKED}, qv AS (SELECT qid, embedding::DOUBLE[] AS v FROM asked JOIN embeddings ON vec_id = qid),
{cosine('qv', S.retrieve_k)}"""


def fuse(near: str, hits: str, k: int, item: str = "doc_id", out: str = "fused") -> str:
    """`out` (qid, item, distance, score, fused, rank) from two rankings."""
    return f"""
{out}_all AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.{item}, l.{item}) AS {item}, d.distance, l.score,
    round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 12) AS fused,
    d.rank AS near_rank, l.rank AS hit_rank
  FROM {near} d FULL OUTER JOIN {hits} l ON d.qid = l.qid AND d.{item} = l.{item}),
{out} AS (SELECT qid, {item}, distance, score, fused, row_number() OVER (PARTITION BY qid
    ORDER BY fused DESC, near_rank NULLS LAST, hit_rank NULLS LAST)::INT AS rank FROM {out}_all QUALIFY rank <= {k})"""


SQL["hybrid_topk"] = f"""
WITH {_DENSE}, {bm25('documents', 'asked', S.retrieve_k)}, {fuse('near', 'hits', S.retrieve_k)} SELECT * FROM fused"""

SQL["orphans"] = f"""
WITH {_DENSE} SELECT qid, doc_id, rank FROM near WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

_GLOSSARY = ", ".join(f"({lit(a)}, {lit(e)})" for a, e in GLOSSARY.items() if a not in AMBIGUOUS)



def rewritten(asked: str) -> str:
    """`rew` (id, q, rewritten, applied) over asked (id, text)."""
    return rf"""
g(abbr, expansion) AS (VALUES {_GLOSSARY}),
tidy AS (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM {asked}),
qtok AS (SELECT id, q, i, l[i] AS tok FROM (SELECT *, regexp_extract_all(q, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*') AS l FROM tidy),
  unnest(range(1, len(l) + 1)) AS r(i)),
qfirst AS (SELECT * FROM qtok QUALIFY row_number() OVER (PARTITION BY id, lower(tok) ORDER BY i) = 1),
added AS (SELECT id, string_agg(expansion, ' ' ORDER BY i) AS extra, string_agg(tok || ' -> ' || expansion, '|' ORDER BY i) AS applied
  FROM qfirst JOIN g ON g.abbr = lower(tok) WHERE NOT contains(lower(q), expansion) GROUP BY ALL),
rew AS (SELECT id, q, CASE WHEN extra IS NULL THEN q ELSE q || ' ' || extra END AS rewritten, coalesce(applied, '') AS applied
  FROM tidy LEFT JOIN added USING (id))"""


SQL["query_rewrite"] = f"""
WITH src AS (SELECT conv_id * 1000 + turn AS id, text || '  TB in PHC, as hypertension HTN, tb' AS text FROM conversations),
{rewritten('src')}
SELECT conv_id, turn, rewritten, applied FROM conversations JOIN rew ON id = conv_id * 1000 + turn"""

# --- gates --------------------------------------------------------------------------------------


def screen(x: str, want: str) -> str:
    out = "CASE"
    for intent, rules in (("emergency", EMERGENCY_RULES), ("personalized_advice", ADVICE_RULES)):
        for pattern, why in rules:
            out += f" WHEN regexp_matches({x}, {lit(pattern)}, 'i') THEN {lit(intent if want == 'intent' else why)}"
    return out + " END"


SQL["intent_rules"] = f"""
WITH q AS (SELECT conv_id, turn, CASE length(text) % 6 WHEN 0 THEN 'Should I take ' WHEN 1 THEN 'I have chest pain and '
  WHEN 2 THEN 'How much should I use ' WHEN 3 THEN 'my blood test ' WHEN 4 THEN 'is this life-threatening: ' ELSE 'what is ' END || text AS q
  FROM conversations)
SELECT conv_id, turn, {screen('q', 'intent')} AS intent, {screen('q', 'reason')} AS reason FROM q"""

_POOL = f"""{_LEX_WIDE},
wide AS (SELECT h.qid, h.doc_id, h.rank, a.text AS question, d.text,
  floor({share(words('a.text'), words('d.text'))} * 10 + 0.5)::DOUBLE AS rerank_score
  FROM hits h JOIN documents d USING (doc_id) JOIN asked a USING (qid)),
first AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank)::INT AS place FROM wide WHERE rank <= {S.retrieve_k})"""

SQL["rerank_scores"] = f"WITH {_POOL} SELECT qid, doc_id, rank, rerank_score, place FROM first"

_VERDICT = """
best AS (SELECT a.qid, count(f.doc_id) AS n_results, max(rerank_score) AS top_score FROM asked a LEFT JOIN first f USING (qid) GROUP BY 1),
verdict AS (SELECT *, CASE WHEN top_score >= 7.5 THEN 'proceed' WHEN top_score >= 6.0 THEN 'correct' ELSE 'refuse' END AS action FROM best)"""

SQL["confidence_gate"] = f"""
WITH {_POOL}, {_VERDICT} SELECT qid, n_results, top_score, action,
  CASE WHEN n_results = 0 THEN 'retrieval returned nothing'
    WHEN top_score IS NULL THEN 'reranker produced no scores; refusing rather than guessing'
    WHEN action = 'proceed' THEN printf('top passage scored %.1f', top_score)
    WHEN action = 'correct' THEN printf('best passage scored %.1f, inside the corrective band [6.0, 7.5) -- retrying retrieval', top_score)
    ELSE printf('best passage scored %.1f < 7.5', top_score) END AS reason FROM verdict"""

_KEPT = """
kept AS (SELECT qid, doc_id, text, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY place) AS n
  FROM first WHERE rerank_score >= 7.5 QUALIFY n <= 6)"""

SQL["kept_passages"] = f"WITH {_POOL}, {_KEPT} SELECT qid, doc_id, 'C' || n AS marker, rerank_score FROM kept"

_MERGED = f"""
merged AS (SELECT qid, doc_id, rerank_score, row_number() OVER (PARTITION BY qid
    ORDER BY rerank_score DESC, rank > {S.retrieve_k}, rank)::INT AS place, rank > {S.retrieve_k} AS is_new FROM wide)"""

SQL["corrective_merge"] = f"WITH {_POOL}, {_MERGED} SELECT * FROM merged"

SQL["corrective_report"] = f"""
WITH {_POOL}, {_VERDICT}, {_MERGED}
SELECT qid, count(*) FILTER (is_new) AS new_candidates, count(*) AS pool,
  max(rerank_score) FILTER (NOT is_new) AS top_before, max(rerank_score) AS top_after,
  max(rerank_score) > max(rerank_score) FILTER (NOT is_new) AS improved
FROM merged WHERE qid IN (SELECT qid FROM verdict WHERE action = 'correct') GROUP BY qid"""

SQL["prompt_context"] = f"""
WITH {_POOL}, {_KEPT}
SELECT qid, string_agg('[C' || n || ' | ' || k.doc_id || ' | ' || d.source || ' | §Body | ' ||
    CASE WHEN n_chars % 3 = 0 THEN 'page n/a' WHEN n_chars % 2 = 0 THEN 'p.' || (n_chars % 3)
      ELSE 'pp.' || (n_chars % 3) || '-' || (n_chars % 3 + 1) END || ']' || chr(10) || k.text, chr(10) || chr(10) ORDER BY n) AS context
FROM kept k JOIN documents d USING (doc_id) GROUP BY qid"""

_DRAFTS = f"""
drafts AS (SELECT a.conv_id, a.turn, q.text AS query, a.text AS answer, {sents('a.text')} AS claims,
  CASE WHEN a.conv_id % 7 = 0 THEN 'C9' WHEN length(a.text) % 2 = 0 THEN 'C1' ELSE a.conv_id || '::' || (a.turn - 1) END AS cited,
  a.conv_id % 11 = 0 AS declined, CASE WHEN length(a.text) % 3 = 0 THEN q.text ELSE a.text END AS passage
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')"""

SQL["citation_check"] = f"""
WITH {_DRAFTS} SELECT conv_id, turn, CASE WHEN cited = 'C9' AND len(claims) > 0 THEN 'C9' ELSE '' END AS invalid FROM drafts"""

SQL["number_provenance"] = f"""
WITH n AS (SELECT d.doc_id, {numbers('d.text')} AS own, {numbers('c.text')} AS cited
  FROM documents d LEFT JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) x ON x.doc_id = d.doc_id + 1, LATERAL (SELECT coalesce(x.text, '') AS text) c)
SELECT doc_id, array_to_string(list_sort(list_filter(own, lambda x: NOT list_contains(cited, x) AND x <> doc_id::VARCHAR)), '|') AS unsupported FROM n"""


def prose_parts(x: str) -> str:
    cut = rf"regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"string_split({cut}, chr(1))"


def repaired(src: str) -> str:
    """`fixed` (.., prose, left) over src (conv_id, turn, answer, claims, bad)."""
    def carries(claim, sentences):
        return f"len(list_filter({sentences}, lambda s: {share(words(claim), words('s'))} >= 0.6)) > 0"

    return f"""
cut AS (SELECT *, list_filter({prose_parts('answer')}, lambda s: len({words('s')}) > 0) AS parts FROM {src}),
judged AS (SELECT *, list_filter(parts, lambda s: len(list_filter(bad, lambda b: {share(words('b'), words('s'))} >= 0.6)) = 0) AS stay,
  list_filter(parts, lambda s: len(list_filter(bad, lambda b: {share(words('b'), words('s'))} >= 0.6)) > 0) AS gone,
  list_filter(claims, lambda c: NOT list_contains(bad, c)) AS remaining FROM cut),
fixed AS (SELECT *, {strip("array_to_string(stay, ' ')")} AS prose,
  list_filter(remaining, lambda c: ({carries('c', 'stay')}) OR NOT ({carries('c', 'gone')})) AS left_over FROM judged),
outcome AS (SELECT *, len(remaining) > 0 AND prose <> '' AND len({words('prose')}) >= 12 AND len(left_over) > 0 AS salvaged FROM fixed)"""


SQL["answer_repair"] = f"""
WITH {_DRAFTS}, src AS (SELECT *, list_filter(claims, lambda c: length(c) % 5 = 0) AS bad FROM drafts), {repaired('src')}
SELECT conv_id, turn, salvaged, CASE WHEN salvaged THEN prose END AS prose,
  CASE WHEN salvaged THEN array_to_string(left_over, '|') END AS claims_left FROM outcome"""

_FLAGS = ", ".join(
    f"CASE WHEN regexp_matches(final, {lit(p)}) THEN {lit(name)} END" for name, p in FRAMING_PHRASES
)


def plain_numbers(x: str) -> str:
    marks = rf"regexp_replace({x}, '\[(?:C[0-9]+)(?:\s*,\s*C[0-9]+)*\]', ' ', 'g')"
    return numbers(rf"regexp_replace({marks}, '(?m)(^|[.!?]\s+)[0-9]+[.)]\s', '\1 ', 'g')")


def gate(drafts: str) -> str:
    """`gated` over drafts (.., answer, claims, declined, invalid, loose, bad0), one row per answer."""
    return f"""
gsrc AS (SELECT * EXCLUDE (bad0, declined), declined OR {strip('answer')} = '' AS no_answer,
  CASE WHEN declined OR {strip('answer')} = '' OR len(claims) = 0 OR invalid OR len(loose) > 0 THEN [] ELSE bad0 END AS bad FROM {drafts}),
{repaired('gsrc')},
done AS (SELECT *, len(bad) > 0 AND len(bad) * 1.0 / greatest(len(claims), 1) <= 0.4 AND salvaged AS mended FROM outcome),
final AS (SELECT *, CASE WHEN mended THEN prose ELSE answer END AS final FROM done),
flagged AS (SELECT *, list_filter([{_FLAGS}], lambda f: f IS NOT NULL) AS flags FROM final),
stops AS (SELECT *, CASE WHEN no_answer THEN 1 WHEN len(claims) = 0 THEN 2 WHEN invalid THEN 3 WHEN len(loose) > 0 THEN 4
  WHEN len(bad) > 0 AND NOT mended THEN 5 WHEN len(flags) > 0 THEN 6 ELSE 0 END AS stop FROM flagged),
gated AS (SELECT *, stop = 0 AS passed, CASE stop WHEN 1 THEN 'model_declined' WHEN 2 THEN 'ungrounded_output'
    WHEN 3 THEN 'ungrounded_output' WHEN 4 THEN 'unsafe_output' WHEN 5 THEN 'ungrounded_output' WHEN 6 THEN 'unsafe_output' END AS reason,
  CASE stop WHEN 1 THEN 'model reported insufficient context' WHEN 2 THEN 'answer carried no claims to verify'
    WHEN 3 THEN 'cited passages that were not retrieved: C9'
    WHEN 4 THEN 'answer contains numbers absent from cited passages: ' || array_to_string(loose, ', ')
    WHEN 5 THEN len(bad) || '/' || len(claims) || ' claim(s) unsupported; answer could not be salvaged'
    WHEN 6 THEN 'framing violations: ' || array_to_string(flags, ', ')
    ELSE CASE WHEN len(bad) > 0 THEN 'passed after stripping ' || len(bad) || ' unsupported claim(s)' ELSE 'all output checks passed' END END AS detail
  FROM stops)"""


_GATE = f"""{_DRAFTS},
loosened AS (SELECT *, cited = 'C9' AND len(claims) > 0 AS invalid,
  list_sort(list_filter({plain_numbers('answer')},
    lambda x: NOT list_contains({numbers('passage')}, x) AND NOT list_contains({numbers('query')}, x))) AS loose,
  list_filter(claims, lambda c: {share(words('c'), words('passage'))} < 0.6) AS bad0 FROM drafts),
{gate('loosened')},
verdicts AS (SELECT conv_id, turn, passed, reason, detail, len(bad)::BIGINT AS n_unsupported FROM gated)"""

SQL["output_gate_verdicts"] = f"WITH {_GATE} SELECT * FROM verdicts"

_MESSAGES = ", ".join(f"({lit(r)}, {lit(m)})" for r, m in REFUSALS.items())

SQL["refusal_messages"] = f"""
WITH {_GATE}, m(reason, message) AS (VALUES {_MESSAGES})
SELECT reason, count(*) AS n, message FROM verdicts JOIN m USING (reason) GROUP BY reason, message"""

# --- evaluation ---------------------------------------------------------------------------------

_RESULTS = """
base AS (SELECT d.doc_id AS id, n_chars, CASE WHEN toxic = 1 THEN 'emergency' WHEN lang = 'de' THEN 'personalized'
  WHEN lang = 'es' THEN 'out_of_domain' WHEN quality = 1 THEN 'answerable' ELSE 'unanswerable' END AS bucket
  FROM documents d JOIN labels USING (doc_id)),
told AS (SELECT *, n_chars % 5 < CASE WHEN bucket = 'answerable' THEN 4 ELSE 1 END AS answered,
  n_chars % 3 AS n_citations, CASE WHEN n_chars % 4 > 0 THEN n_chars % 4 > 1 END AS hit,
  CASE WHEN bucket = 'unanswerable' THEN (n_chars % 11) / 2 ELSE (n_chars % 17) / 2 + 2 END AS score FROM base),
res AS (SELECT *, CASE WHEN NOT answered THEN CASE WHEN n_chars % 7 = 0 THEN 'low_confidence' WHEN bucket = 'emergency' THEN 'emergency'
    WHEN bucket = 'personalized' THEN 'personalized_advice' WHEN bucket = 'out_of_domain' THEN 'out_of_domain' ELSE 'model_declined' END END AS got,
  CASE bucket WHEN 'unanswerable' THEN ['low_confidence', 'model_declined'] WHEN 'personalized' THEN ['personalized_advice']
    WHEN 'emergency' THEN ['emergency'] WHEN 'out_of_domain' THEN ['low_confidence', 'out_of_domain'] ELSE [] END AS want FROM told),
judged AS (SELECT *, CASE WHEN bucket = 'answerable' THEN answered AND n_citations > 0
    ELSE NOT answered AND coalesce(list_contains(want, got), false) END AS correct,
  CASE WHEN bucket = 'answerable' AND NOT answered THEN 'refused (' || got || ') but should have answered'
    WHEN bucket = 'answerable' AND n_citations = 0 THEN 'answered without citations'
    WHEN bucket = 'answerable' THEN 'answered with citations' WHEN answered THEN 'answered but should have refused'
    WHEN NOT list_contains(want, got) THEN 'refused as ' || got || ', expected ' || array_to_string(want, '/')
    ELSE 'refused as ' || got END AS detail FROM res)"""

SQL["eval_judge"] = f"WITH {_RESULTS} SELECT id, bucket, correct, detail FROM judged"

SQL["eval_metrics"] = f"""
WITH {_RESULTS}, both_ AS (SELECT bucket AS shown, * FROM judged UNION ALL SELECT 'all', * FROM judged)
SELECT shown AS bucket, count(*) AS n, round(avg(correct::INT), 6) AS accuracy,
  round(coalesce(avg((NOT answered)::INT) FILTER (bucket IN ('personalized', 'emergency')), 0), 6) AS safety_compliance,
  round(coalesce(avg((NOT answered)::INT) FILTER (bucket = 'answerable'), 0), 6) AS false_refusal_rate,
  round(avg(hit::INT), 6) AS retrieval_hit_rate FROM both_ GROUP BY shown"""

SQL["retrieval_hit"] = f"""
WITH {_ASKED}, {bm25('documents', 'asked', S.rerank_top_n)}
SELECT h.qid AS id, bool_or(CASE WHEN h.qid % 4 = 0
  THEN contains(lower(d.source), 'src' || (h.qid % 20)) OR contains(d.doc_id::VARCHAR, 'src' || (h.qid % 20))
  ELSE contains(lower(d.text), lower(a.text)) END) AS hit
FROM hits h JOIN documents d USING (doc_id) JOIN asked a USING (qid) GROUP BY h.qid"""

_GRID = f"""{_RESULTS},
grid AS (SELECT i * 0.5::DOUBLE AS threshold, count(*) FILTER (bucket = 'answerable' AND score >= i * 0.5) AS answerable_kept,
  count(*) FILTER (bucket = 'answerable' AND score < i * 0.5) AS answerable_lost,
  count(*) FILTER (bucket = 'unanswerable' AND score < i * 0.5) AS unanswerable_refused,
  count(*) FILTER (bucket = 'unanswerable' AND score >= i * 0.5) AS unanswerable_leaked,
  count(*) FILTER ((bucket = 'answerable') = (score >= i * 0.5)) * 1.0::DOUBLE / count(*) AS accuracy
  FROM judged, unnest(range(0, 21)) AS r(i) WHERE bucket IN ('answerable', 'unanswerable') GROUP BY i)"""

SQL["threshold_grid"] = f"WITH {_GRID} SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM grid"

SQL["threshold_pick"] = f"""
WITH {_GRID}, b AS (SELECT threshold, row_number() OVER (ORDER BY threshold) AS r FROM grid WHERE accuracy = (SELECT max(accuracy) FROM grid)),
runs AS (SELECT list(threshold ORDER BY threshold) AS l FROM b GROUP BY (threshold * 2)::BIGINT - r)
SELECT l[len(l) // 2 + 1] AS threshold FROM runs ORDER BY len(l) DESC, l[1] LIMIT 1"""

SQL["top_scores"] = f"""
WITH {_POOL} SELECT CASE a.qid % 3 WHEN 0 THEN 'answerable' ELSE 'unanswerable' END AS bucket, a.qid, coalesce(max(rerank_score), 0) AS score
FROM asked a LEFT JOIN first f USING (qid) WHERE a.qid % 3 < 2 GROUP BY a.qid"""

# --- accounts, history, quotas ------------------------------------------------------------------

_TURNS = f"turns AS (SELECT user_id, printf('%012d', event_id) AS id, {ISO.format('ts')} AS created_at FROM events)"
_DAY = f"{ISO.format('(DATE ' + lit('2023-01-01') + ' + (c_custkey % 300)::INT)::TIMESTAMP')}"
_USERS = f"""users AS (SELECT c_custkey AS id, lower(c_name) AS email, {_DAY} AS created_at,
  CASE WHEN c_custkey % 5 = 0 THEN {_DAY} END AS verified_at FROM customer)"""
_MARK = "SELECT user_id, {0}(" + ISO.format("ts") + ") AS moment FROM events WHERE event_type = '{1}' GROUP BY 1"

SQL["register_users"] = """
WITH s AS (SELECT c_custkey % 700 AS n, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT s_suppkey * 3, 's' || s_suppkey FROM supplier),
a AS (SELECT 'user' || n || '@example.org' AS email, printf('2024-01-%02d', n % 28 + 1) AS created_at, id FROM s),
f AS (SELECT email, min(created_at || chr(1) || id) AS m FROM a GROUP BY 1),
u AS (SELECT 'n' || n_nationkey AS id, 'user' || n_nationkey || '@example.org' AS email, '2023-01-01' AS created_at FROM nation)
SELECT id, email, created_at FROM u UNION ALL
SELECT string_split(m, chr(1))[2], email, string_split(m, chr(1))[1] FROM f WHERE email NOT IN (SELECT email FROM u)"""

SQL["first_verified"] = f"""
WITH {_USERS}, m AS ({_MARK.format('min', 'signup')})
SELECT id, email, coalesce(verified_at, moment) AS verified_at FROM users LEFT JOIN m ON user_id = id"""

SQL["latest_password"] = f"""
WITH {_USERS}, m AS ({_MARK.format('max', 'error')}) SELECT id, moment AS password_changed_at FROM users LEFT JOIN m ON user_id = id"""

SQL["session_valid"] = """
WITH p AS (SELECT user_id, max(epoch_us(ts) // 1000) AS changed FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, e.user_id, epoch_us(ts) // 1000 AS issued_at_ms FROM events e JOIN customer ON c_custkey = e.user_id LEFT JOIN p ON p.user_id = e.user_id
WHERE event_type = 'click' AND (changed IS NULL OR epoch_us(ts) // 1000 >= changed)"""

SQL["cascade_delete"] = """
SELECT c_custkey AS id, count(o_orderkey) AS n_turns FROM customer LEFT JOIN orders ON o_custkey = c_custkey
WHERE NOT c_acctbal < 0 GROUP BY 1"""

SQL["history_prune"] = f"""
WITH {_TURNS} SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 50"""

SQL["history_page"] = f"""
WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM turns),
c AS (SELECT user_id, created_at AS before FROM n WHERE r = 20)
SELECT t.user_id, t.id, t.created_at, row_number() OVER (PARTITION BY t.user_id ORDER BY created_at DESC, id DESC)::INT AS place
FROM turns t JOIN c ON c.user_id = t.user_id AND t.created_at < c.before QUALIFY place <= 20"""

SQL["history_delete"] = f"""
WITH {_TURNS} SELECT t.user_id, t.id FROM turns t JOIN events e ON e.event_id = t.id::BIGINT
WHERE e.event_type <> 'view' AND t.user_id % 10 <> 7"""

SQL["history_get"] = f"WITH {_TURNS} SELECT user_id, id, created_at FROM turns WHERE id::BIGINT % 3 <> 0"

SQL["stored_citations"] = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n,
  CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS chunk_id,
  CASE WHEN event_id % 2 = 0 THEN (user_id % 11)::DOUBLE END AS rerank_score FROM events"""

SQL["users_list"] = f"WITH {_USERS} SELECT id, email, created_at FROM users ORDER BY created_at, id"

SQL["rate_limit"] = """
WITH w AS (SELECT event_id, user_id, ts, epoch_us(ts) // 1000000 AS sec FROM events),
n AS (SELECT *, sec // 86400 AS win, row_number() OVER (PARTITION BY user_id, sec // 86400 ORDER BY ts, event_id) AS r FROM w)
SELECT event_id, user_id, win::BIGINT AS "window", r <= 2 AS allowed, greatest(2 - r, 0)::BIGINT AS remaining,
  ((win + 1) * 86400 - sec)::BIGINT AS retry_after_s FROM n"""

SQL["history_migrated"] = f"""
WITH u AS (SELECT user_id AS id, 'u' || user_id || '@example.org' AS email, {ISO.format('min(ts)')} AS created_at,
  {ISO.format('max(ts)')} AS last FROM events GROUP BY 1),
m AS (SELECT id, email, created_at, CASE WHEN id % 3 = 0 THEN created_at WHEN id % 2 = 0 THEN last END AS verified_at,
  CASE WHEN id % 3 = 2 AND id % 5 = 0 THEN last END AS password_changed_at, (id % 3 + 1)::INT AS schema_version FROM u)
SELECT *, 'mixed' AS stage FROM m UNION ALL SELECT * REPLACE (3 AS schema_version), 'migrated' AS stage FROM m"""

SQL["window_counts"] = """
SELECT user_id, (epoch_us(ts) // 1000000 // 3600)::BIGINT AS "window", count(*) AS n, greatest(count(*) - 5, 0)::BIGINT AS refused
FROM events GROUP BY ALL"""

SQL["failure_runs"] = f"""
WITH m AS (SELECT *, event_type IN ('error', 'view') AS failed,
  sum((NOT event_type IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, min({ISO.format('ts')}) AS run_start, max({ISO.format('ts')}) AS run_end, count(*) AS failures, count(*) // 3 AS trips
FROM m WHERE failed GROUP BY user_id, run"""

SQL["cache_entries"] = """
SELECT user_id, max_by(event_id, ts) AS event_id FROM events
WHERE ts + INTERVAL 5 DAY > (SELECT max(ts) FROM events) GROUP BY user_id"""

# --- manifests ----------------------------------------------------------------------------------

_DIFF = """
f AS (SELECT 'doc-' || doc_id || '.txt' AS filename, sha256(text) AS sha FROM documents),
l AS (SELECT 'doc-' || doc_id || '.txt' AS filename, CASE WHEN toxic = 1 THEN 'stale' ELSE sha256(text) END AS sha
  FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'item-' || item_id || '.txt', sha256(text) FROM benchmark),
diff AS (SELECT coalesce(l.filename, f.filename) AS filename, CASE WHEN f.filename IS NULL THEN 'missing'
  WHEN l.filename IS NULL THEN 'unlisted' WHEN l.sha = f.sha THEN 'ok' ELSE 'changed' END AS status
  FROM l FULL OUTER JOIN f ON f.filename = l.filename)"""

SQL["manifest_diff"] = f"WITH {_DIFF} SELECT * FROM diff"
SQL["manifest_summary"] = f"""
WITH {_DIFF} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing') AS missing,
  count(*) FILTER (status = 'unlisted') AS unlisted, count(*) FILTER (status = 'changed') AS changed, bool_and(status = 'ok') AS clean FROM diff"""

SQL["index_manifest"] = """
SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'indexed' ELSE 'skipped' END AS state, count(*) AS n
FROM documents GROUP BY ALL"""

SQL["embeddings_missing"] = """
WITH k AS (SELECT doc_id, sha256('m|64|' || text) AS key FROM documents)
SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM k JOIN labels USING (doc_id)) GROUP BY key"""

SQL["question_dedupe"] = r"""
SELECT substr(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || '|True'), 1, 32) AS response_key, count(*) AS n
FROM conversations GROUP BY 1"""

# --- the whole path -----------------------------------------------------------------------------


def hashed(src: str, out: str) -> str:
    """`out` (id, slot, x) and `out_n` (id, n): signed feature hashing of src (id, text) into 64 slots."""
    return f"""
{out}_h AS (SELECT id, ('0x' || substr(md5(unnest({toks('text')})), 1, 8))::BIGINT AS h FROM {src}),
{out} AS (SELECT id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM {out}_h GROUP BY ALL),
{out}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {out} GROUP BY 1)"""


SQL["answer_responses"] = f"""
WITH RECURSIVE {_CHUNKS},
pas AS (SELECT chunk_id, source AS title, path, c.text FROM chunks c JOIN documents USING (doc_id)),
idx AS (SELECT chunk_id AS doc_id, title || ' ' || path || ' ' || text AS text FROM pas),
bench AS (SELECT item_id AS id, text FROM benchmark), {rewritten('bench')},
screened AS (SELECT id AS qid, text AS question, rewritten, {screen('text', 'intent')} AS intent FROM bench JOIN rew USING (id)),
asked AS (SELECT qid, question, rewritten AS text FROM screened WHERE intent IS NULL),
{bm25('idx', 'asked', S.corrective_k)},
vsrc AS (SELECT chunk_id AS id, title || ' — ' || path || chr(10) || chr(10) || text AS text FROM pas), {hashed('vsrc', 'pv')},
qsrc AS (SELECT qid AS id, text FROM asked), {hashed('qsrc', 'qv')},
dots AS (SELECT q.id AS qid, p.id AS doc_id, sum(q.x * p.x) AS dot FROM qv q JOIN pv p USING (slot) GROUP BY ALL),
near AS (SELECT qid, doc_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id)::INT AS rank
  FROM (SELECT qid, doc_id, round(1 - dot / (a.n * b.n), 6) AS distance FROM dots JOIN qv_n a ON a.id = qid JOIN pv_n b ON b.id = doc_id)
  QUALIFY rank <= {S.corrective_k}),
near1 AS (SELECT * FROM near WHERE rank <= {S.retrieve_k}), hits1 AS (SELECT * FROM hits WHERE rank <= {S.retrieve_k}),
{fuse('near1', 'hits1', S.retrieve_k, out='f1')}, {fuse('near', 'hits', S.corrective_k, out='f2')},
scored AS (SELECT f.qid, f.doc_id, f.rank, f.pass, p.text, a.question,
  floor({share(words('a.question'), words('p.text'))} * 10 + 0.5)::DOUBLE AS s
  FROM (SELECT qid, doc_id, rank, 1 AS pass FROM f1 UNION ALL SELECT qid, doc_id, rank, 2 FROM f2) f
  JOIN pas p ON p.chunk_id = f.doc_id JOIN asked a USING (qid)),
first AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS place FROM scored WHERE pass = 1),
best AS (SELECT a.qid, max(s) AS top FROM asked a LEFT JOIN first USING (qid) GROUP BY 1),
verdict AS (SELECT *, CASE WHEN top >= 7.5 THEN 'proceed' WHEN top >= 6.0 THEN 'correct' ELSE 'refuse' END AS action FROM best),
pool AS (SELECT qid, doc_id, text, question, s, pass, place AS pos FROM first
  UNION ALL SELECT w.qid, w.doc_id, w.text, w.question, w.s, 2, w.rank FROM scored w JOIN verdict v ON v.qid = w.qid AND v.action = 'correct'
  WHERE pass = 2 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.qid = w.qid AND f.doc_id = w.doc_id)),
tops AS (SELECT qid, max(s) AS top_score FROM pool GROUP BY 1),
held AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pass, pos, doc_id) AS n FROM pool WHERE s >= 7.5 QUALIFY n <= {S.rerank_top_n}),
cand AS (SELECT qid, n, doc_id, text, question, i, l[i] AS sentence FROM (SELECT *, {sents('text')} AS l FROM held), unnest(range(1, len(l) + 1)) AS r(i)),
chosen AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY qid, n ORDER BY {share(words('question'), words('sentence'))} DESC, i) = 1),
loosened AS (SELECT qid, string_agg(sentence || ' [C' || n || ']', ' ' ORDER BY n) AS answer, list(sentence ORDER BY n) AS claims,
  string_agg('C' || n || '=' || doc_id, '|' ORDER BY n) AS cited, false AS declined, false AS invalid,
  list_sort(list_filter({plain_numbers("string_agg(sentence || ' [C' || n || ']', ' ' ORDER BY n)")},
    lambda x: NOT list_contains({numbers('string_agg(text, chr(10) ORDER BY n)')}, x) AND NOT list_contains({numbers('any_value(question)')}, x))) AS loose,
  list(sentence ORDER BY n) FILTER ({share(words('sentence'), words('text'))} < 0.6) AS bad0 FROM chosen GROUP BY qid),
ready AS (SELECT * REPLACE (coalesce(bad0, []) AS bad0) FROM loosened), {gate('ready')},
m(why, message) AS (VALUES {_MESSAGES}),
told AS (SELECT q.qid, q.intent, v.action, t.top_score, g.final, g.cited,
  CASE WHEN q.intent IS NOT NULL THEN q.intent WHEN coalesce(t.top_score, 0) < 7.5 THEN 'low_confidence' ELSE coalesce(g.reason, CASE WHEN g.qid IS NULL THEN 'model_declined' END) END AS why
  FROM screened q LEFT JOIN verdict v USING (qid) LEFT JOIN tops t USING (qid) LEFT JOIN gated g USING (qid))
SELECT qid, why IS NULL AS answered, why AS refusal_reason, top_score, coalesce(message, final) AS answer,
  CASE WHEN why IS NULL THEN cited ELSE '' END AS cited, action AS first_action FROM told LEFT JOIN m USING (why)"""

# --- streams ------------------------------------------------------------------------------------

SQL["stream_window_counts"] = """
SELECT user_id, (epoch_us(ts) // 1000000 // 3600)::BIGINT AS "window", count(*) AS n FROM events GROUP BY ALL"""

SQL["stream_first_requests"] = """
SELECT DISTINCT user_id || '|' || event_type || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS request FROM events"""

SQL["stream_pruned_turns"] = f"""
WITH {_TURNS} SELECT user_id, id FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) > 50"""

SQL["stream_breaker"] = """
WITH RECURSIVE c AS (SELECT user_id, event_id, value > 20 AS failed, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, 0::BIGINT AS r, 0 AS failures, 0::BIGINT AS closed, 0::BIGINT AS event_id, true AS attempted, false AS opened
    FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL
  SELECT c.user_id, c.r, CASE WHEN c.t < w.closed THEN w.failures WHEN NOT c.failed OR w.failures = 2 THEN 0 ELSE w.failures + 1 END,
    CASE WHEN c.t >= w.closed AND c.failed AND w.failures = 2 THEN c.t + 60000000 ELSE w.closed END,
    c.event_id, c.t >= w.closed, c.t >= w.closed AND c.failed AND w.failures = 2
  FROM w JOIN c ON c.user_id = w.user_id AND c.r = w.r + 1)
SELECT user_id, event_id, attempted, opened FROM w WHERE r > 0"""

# --- reuse and failures -------------------------------------------------------------------------

SQL["response_reuse"] = r"""
WITH a AS (SELECT conv_id || '::' || turn AS qid, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k, length(text) % 3 = 0 AS early
  FROM conversations WHERE role = 'user'),
k AS (SELECT k, bool_or(early) AS first, length(k) % 5 = 0 AS down FROM a GROUP BY k),
r AS (SELECT run, qid, down, CASE WHEN run = 2 AND first AND NOT down THEN 1 WHEN run = 4 AND NOT first AND NOT down THEN 2 ELSE run END AS made
  FROM a JOIN k USING (k), (VALUES (1), (2), (3), (4)) runs(run) WHERE run > 1 OR early)
SELECT run, qid, 'run ' || made AS answer, CASE WHEN made <> run THEN 'hit' END AS cache, CASE WHEN down THEN 'intent_classifier' ELSE '' END AS degraded FROM r"""

SQL["answer_trace"] = f"""
WITH RECURSIVE asked AS (SELECT conv_id || '::' || turn AS id, text FROM conversations WHERE role = 'user'), {rewritten('asked')},
q AS (SELECT id, length(text) AS n, length(rewritten) % 5 = 0 AS unblended, len({toks('rewritten')}) > 0 AS worded, {screen('text', 'intent')} AS rule
  FROM asked JOIN rew USING (id)),
s AS (SELECT *, rule IS NULL AND n % 7 = 0 AS closed, rule IS NULL AND n % 7 <> 0 AS scope FROM q),
f AS (SELECT *, scope AND unblended AS f_blend, scope AND (worded OR NOT unblended) AS found FROM s),
rk AS (SELECT *, found AND n % 4 = 0 AS f_rank, found AND n % 4 <> 0 AS ranked FROM f),
h AS (SELECT *, ranked AND n % 3 = 0 AS f_draft, ranked AND n % 3 <> 0 AND n % 11 = 0 AS f_support,
  ranked AND n % 3 <> 0 AND n % 11 <> 0 AND n % 13 = 0 AS f_framing FROM rk)
SELECT id AS qid, ranked AND NOT (f_draft OR f_support OR f_framing) AS answered,
  CASE WHEN closed THEN 'out_of_domain' WHEN rule IS NOT NULL THEN rule WHEN NOT ranked THEN 'low_confidence' WHEN f_draft THEN 'model_declined'
    WHEN f_support THEN 'ungrounded_output' WHEN f_framing THEN 'unsafe_output' END AS refusal_reason,
  concat_ws('|', CASE WHEN closed THEN 'intent_classifier' END, CASE WHEN f_blend THEN 'blend' END, CASE WHEN f_rank THEN 'reranker' END,
    CASE WHEN f_draft THEN 'generator' END, CASE WHEN f_support THEN 'support_judge' END, CASE WHEN f_framing THEN 'safety_classifier' END) AS degraded,
  'intent' || CASE WHEN scope THEN ',retrieve,rerank,confidence' ELSE '' END || CASE WHEN ranked THEN ',generate,output_gate' ELSE '' END AS stages,
  CASE WHEN NOT scope THEN 'no retrieval performed' END AS short_circuited,
  CASE WHEN f_blend THEN 'failed' WHEN scope THEN 'used' END AS blend,
  CASE WHEN ranked THEN CASE WHEN f_draft OR f_support OR f_framing THEN 'false' ELSE 'true' END END AS passed
FROM h"""
