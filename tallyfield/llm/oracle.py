"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tallyfield.llm.licenses import BASE, BASE_WORTH, WORTH, signature_rules
from tallyfield.llm.mixing import UNIT, MixSettings
from tallyfield.llm.near import NearSettings
from tallyfield.llm.quality import RepeatLimits

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x20\x09-\x0D]+"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])"

OP2 = f"""
WITH turns AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
  ELSE 17 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars FROM turns)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(SUM(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(COALESCE(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT k, i FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM rep),
word AS (SELECT k, i, w[i] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT word.k, string_agg(word, ' ' ORDER BY word.i) AS t, COUNT(*) AS n FROM word ANTI JOIN gone ON gone.k = word.k AND gone.i = word.i GROUP BY word.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)"""

_N = NearSettings()
OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {_N.words - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {_N.words - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM pair p JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b WHERE 100 * p.n >= {_N.percent} * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)"""

_M = MixSettings()
# The tree is walked from the root: turn m of a node is the first half's if the half's rounded share of the turns grows there.
OP6 = f"""
WITH RECURSIVE src AS (SELECT source, COUNT(*) AS n, CAST(floor(sqrt(COUNT(*)) * {UNIT}) AS BIGINT) AS k FROM documents GROUP BY source),
ranked AS (SELECT *, length(bin(k)) AS c, row_number() OVER (PARTITION BY length(bin(k)) ORDER BY source NULLS FIRST) - 1 AS r FROM src),
node AS (SELECT c, l, r >> l AS b, CAST(SUM(k) AS HUGEINT) AS w FROM ranked, (SELECT unnest(range(0, 40)) AS l) GROUP BY ALL),
class AS (SELECT c, MAX(w) AS w, MIN(l) FILTER (w = top) AS l FROM (SELECT *, MAX(w) OVER (PARTITION BY c) AS top FROM node) GROUP BY c),
spine AS (SELECT 's' || c AS id, 'n' || c || '_' || l || '_0' AS a, w AS wa, 's' || lag(c) OVER o AS b, CAST(COALESCE(SUM(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS wb FROM class WINDOW o AS (ORDER BY c)),
half AS (SELECT id, a, wa, b, wb FROM spine UNION ALL SELECT 'n' || p.c || '_' || p.l || '_' || p.b, 'n' || x.c || '_' || x.l || '_' || x.b, x.w, 'n' || y.c || '_' || y.l || '_' || y.b, COALESCE(y.w, 0)
  FROM node p JOIN node x ON x.c = p.c AND x.l = p.l - 1 AND x.b = 2 * p.b LEFT JOIN node y ON y.c = p.c AND y.l = p.l - 1 AND y.b = 2 * p.b + 1),
tot AS (SELECT CAST(SUM(k) AS HUGEINT) AS k, (SELECT 's' || MAX(c) FROM class) AS root FROM src),
walk AS (SELECT CAST(unnest(range(0, (SELECT CAST(MAX((n // {_M.quantum} + 3) * t.k // s.k + 1) AS BIGINT) FROM src s, tot t))) AS HUGEINT) AS slot, root AS id, slot AS m FROM tot
  UNION ALL SELECT slot, CASE WHEN y > x THEN a ELSE b END, CASE WHEN y > x THEN x ELSE m - x END FROM (
    SELECT slot, m, a, b, (2 * m * wa + wa + wb) // (2 * (wa + wb)) AS x, (2 * m * wa + 3 * wa + wb) // (2 * (wa + wb)) AS y FROM walk JOIN half USING (id))),
served AS (SELECT source, m AS j, slot FROM walk JOIN ranked ON id = 'n' || c || '_0_' || r),
doc AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS x FROM documents)
SELECT doc_id, d.source, x AS mix_index, x // {_M.block} AS mix_block, CAST(greatest(j - 1, 0) * t.k // s.k AS BIGINT) AS mix_release, CAST(((j + 2) * t.k + s.k - 1) // s.k AS BIGINT) AS mix_deadline,
  CAST(slot AS BIGINT) AS mix_slot, CAST(slot * {_M.quantum} + x % {_M.quantum} AS BIGINT) AS mix_position
FROM doc d JOIN src s ON s.source IS NOT DISTINCT FROM d.source JOIN served v ON v.source IS NOT DISTINCT FROM d.source AND v.j = x // {_M.quantum}, tot t"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10"""



def _rules() -> str:
    """Rows (label, priority, keywords, pattern). Here words stand as " 0:word " each, so that a match may take
    the space after its last word: there is no look ahead."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    body = lambda r: " [0-9]+:" + r["re"].removeprefix(" ").removesuffix("(?= )").replace(" ", "(?:  [0-9]+:)") + " "
    return ", ".join(f"({quoted(r['label'])}, {r['prio']}, string_split({quoted(r['kw'])}, ' '), {quoted(body(r))})" for r in signature_rules())


OP8 = f"""
WITH rule(label, prio, kw, re) AS (VALUES {_rules()}),
t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT k, label, i - 1 AS i FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM t) JOIN (VALUES {", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in BASE)}) b(p, label) ON list_slice(w, i, i + len(p) - 1) = p),
based AS (SELECT k, COUNT(*) AS n, MIN(i) AS a, MAX(i) AS b, list(DISTINCT label) AS labels FROM place GROUP BY k),
gated AS (SELECT k, g.kw, array_to_string(list_transform(w, lambda x, i: ' ' || (i - 1) || ':' || x || ' '), '') AS v FROM t JOIN (SELECT DISTINCT kw FROM rule) g ON list_has_all(list_distinct(w), g.kw)),
hit AS (SELECT k, label, prio, unnest(regexp_extract_all(v, re)) AS m FROM gated JOIN rule ON rule.kw = gated.kw),
found AS (SELECT DISTINCT k, label, prio, CAST(split_part(trim(m), ':', 1) AS INT) AS a, CAST(split_part(list_last(string_split(trim(m), ' ')), ':', 1) AS INT) + 1 AS b FROM hit),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.k = f.k AND e.a <= f.a AND e.b >= f.b AND e.prio <= f.prio AND (e.b - e.a > f.b - f.a OR e.b - e.a = f.b - f.a AND e.prio < f.prio))),
named AS (SELECT k, list(DISTINCT label) AS labels, MAX(CASE prio WHEN 1 THEN {WORTH[1]} WHEN 2 THEN {WORTH[2]} ELSE {WORTH[3]} END) AS worth FROM kept GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_base, a AS first_word, b AS last_word, COALESCE(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
  COALESCE(array_to_string(list_sort(list_distinct(list_concat(COALESCE(based.labels, []), COALESCE(named.labels, [])))), ','), '') AS labels,
  CAST(greatest(COALESCE(worth, 0), CASE WHEN n > 0 THEN {BASE_WORTH} ELSE 0 END) AS DOUBLE) AS score FROM t LEFT JOIN based USING (k) LEFT JOIN named USING (k)"""

_BYTES = 200
# Bytes as pairs of hexadecimal digits; windows of a text that is too short are none.
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
part AS (SELECT k, c, substr(h, 1000 * c + 1, {1000 + 2 * _BYTES - 2}) AS s FROM (SELECT k, h, unnest(range(0, length(h) // 1000 + 1)) AS c FROM d)),
win AS (SELECT k, 500 * c + j AS i, md5(substr(s, 2 * j + 1, {2 * _BYTES})) AS v FROM (SELECT k, c, s, unnest(range(0, length(s) // 2 - {_BYTES - 1})) AS j FROM part)),
rep AS (SELECT k, i FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY v) AS n FROM win) WHERE n > 1),
run AS (SELECT k, MIN(i) AS a, MAX(i) + {_BYTES} AS b FROM (SELECT k, i, SUM(CASE WHEN i <= p + {_BYTES} THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM rep)) GROUP BY k, g),
gone AS (SELECT k, SUM(b - a) AS n, COUNT(*) AS spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM run GROUP BY k),
kept AS (SELECT d.*, n, spans, CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END, CASE WHEN j = 0 THEN 2 * a[1] WHEN j = len(a) THEN length(h) ELSE 2 * (a[j + 1] - b[j]) END)), '') END AS left_over FROM d LEFT JOIN gone USING (k))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, COALESCE(spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM kept"""

_L = RepeatLimits()


def _covered(length: int) -> str:
    """Words of each document inside windows of ``length`` words that stand in it twice or more."""
    return f"""(SELECT k, COUNT(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + {length})) FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY k, h) AS c FROM
  (SELECT k, i, md5(array_to_string(list_slice(w, i, i + {length - 1}), ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d))) WHERE c > 1) GROUP BY k)"""


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '{WORDS}') AS w FROM documents),
lines AS (SELECT k, COUNT(*) - COUNT(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORDS}') GROUP BY k),
r5 AS {_covered(_L.window)}, r12 AS {_covered(_L.min_repeat)},
long AS (SELECT DISTINCT k FROM (SELECT k, COUNT(*) OVER (PARTITION BY k, h) AS c FROM (SELECT k, md5(array_to_string(list_slice(w, i, i + m - 1), ' ')) AS h FROM
  (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, greatest({_L.max_longest} + 1, {_L.max_longest_percent} * len(w) // 100 + 1) AS m FROM d)))) WHERE c > 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, COALESCE(lines.n, 0) AS n_dup_lines, COALESCE(r5.n, 0) AS n_repeat_words, COALESCE(r12.n, 0) AS covered_words, long.k IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (k) LEFT JOIN r5 USING (k) LEFT JOIN r12 USING (k) LEFT JOIN long USING (k))
SELECT * EXCLUDE (too_long), n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_percent} * n_words AS base_failed,
  NOT (n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_percent} * n_words OR 100 * covered_words > {_L.max_covered_percent} * n_words OR too_long) AS kept FROM m"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": OP2, "op3_fm_substring_dedup": OP3, "op5_minhash_near_dedup": OP5, "op6_source_mix": OP6,
        "op7_topk_search": OP7, "op8_license_scan": OP8, "op9_suffix_dedup": OP9, "op10_repetition_quality": OP10,
    }
