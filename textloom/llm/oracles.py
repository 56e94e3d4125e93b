"""SQL for the queries of this subpackage that SQL can express, by plain definitions: all runs, all stretches, all pairs.

Not expressed: estimates (``p3_*``, ``p8_reading_level``), distances from references (``p5_repetition``), alignments (``p6_partial_leaks``) and
drawn samples (``p7_*``); the tests check these by other means.
"""

from __future__ import annotations

import re

from textloom.llm.reading_level import ABBREVIATIONS, SPACED

_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _value(json: str, key: str) -> str:
    return f"""CAST(json_extract({json}, '$."' || {key} || '"') AS VARCHAR)"""


# The fields of an object in order of name, objects within it likewise (one level, which is what the table has).
_FIELDS = f"""list_sort(list_transform(json_keys(m), lambda k: k || '=' || CASE WHEN json_type(m, '$."' || k || '"') = 'OBJECT'
  THEN CAST(list_sort(list_transform(json_keys(m, '$."' || k || '"'), lambda j: j || '=' || {_value("json_extract(m, '$.' || chr(34) || k || chr(34))", "j")})) AS VARCHAR)
  ELSE {_value("m", "k")} END))"""

_RECORDS = f"""WITH d AS (SELECT DISTINCT doc_id, {_CANON.format("text")} AS t FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT DISTINCT doc_id, nullif({_CANON.format("path")}, '') AS p, metadata FROM text_meta),
v AS (SELECT metadata, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata END AS m FROM (SELECT DISTINCT metadata FROM x WHERE metadata IS NOT NULL)),
f AS (SELECT metadata, CASE WHEN m IS NULL THEN metadata ELSE nullif(CAST({_FIELDS} AS VARCHAR), '[]') END AS c FROM v),
r AS (SELECT DISTINCT d.doc_id, d.t, coalesce(x.p, '') AS p, coalesce(f.c, '') AS c FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN f ON x.metadata = f.metadata WHERE d.t <> ''),
g AS (SELECT t, p, c, min(doc_id) AS keep_doc_id, count(*) AS copies FROM r GROUP BY t, p, c)"""

_SPANS = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
s AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d),
h AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS k FROM s),
q AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)),
a AS (SELECT DISTINCT doc_id, i FROM h WHERE k IN (SELECT k FROM q)),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM a),
o AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n),
z AS (SELECT doc_id, CAST(min(i) AS BIGINT) AS span_start, CAST(max(i) + 200 AS BIGINT) AS span_end FROM o GROUP BY doc_id, island)"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _runs(n: int) -> str:
    return f"list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"


_PAIRS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, unnest({_runs(3)}) AS g FROM d WHERE len(w) >= 20),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT b.a AS doc_id_a, b.b AS doc_id_b FROM b JOIN n x ON b.a = x.doc_id JOIN n y ON b.b = y.doc_id WHERE 5 * common >= 3 * (x.n + y.n - common)"""

_GROUPS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT array_to_string(w, ' ') AS class, any_value(w) AS w, min(doc_id) AS id FROM d WHERE len(w) >= 1 GROUP BY 1),
m AS (SELECT d.doc_id, c.id FROM d JOIN c ON array_to_string(d.w, ' ') = c.class WHERE len(d.w) >= 1),
s AS (SELECT id, unnest({_runs(5)}) AS g FROM c WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
e AS (SELECT b.a, b.b FROM b JOIN n x ON b.a = x.id JOIN n y ON b.b = y.id WHERE 5 * common >= 4 * (x.n + y.n - common)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS id, least(a, min(b)) AS group_id FROM r GROUP BY a),
l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, CAST(coalesce(g.group_id, m.id, d.doc_id) AS BIGINT) AS group_id, CAST(coalesce(l.links, 0) AS BIGINT) AS links
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN g ON m.id = g.id LEFT JOIN l ON m.id = l.id"""

_REPETITIVE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM s),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM r) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM a) GROUP BY doc_id)
SELECT d.doc_id FROM d JOIN c ON d.doc_id = c.doc_id WHERE len(d.w) >= 20 AND 2 * c.n >= len(d.w)"""

_LEAKS = f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT item_id, array_to_string(w, ' ') AS g, len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND 12
      UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))), 13 FROM i WHERE len(w) >= 13),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) >= 13)
SELECT DISTINCT p.item_id, s.doc_id FROM p JOIN s ON p.g = s.g WHERE p.n = 13
UNION SELECT DISTINCT p.item_id, d.doc_id FROM p JOIN d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || p.g || ' ') WHERE p.n < 13"""


def _sentences() -> str:
    """Dots of abbreviations are taken out (twice, as neighbours share a border), then texts are cut at ends of sentences."""
    blank = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    quoted = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    t = "lower(text)"
    for a, b in SPACED:
        t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}.])(\.*)({a})\.([{blank}])({b})\.([{blank}]|$)', '\1\2\3\4\5 \6', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}.])(\.*)({quoted(ABBREVIATIONS)})\.([{blank}]|$)', '\1\2\3 \4', 'g')"
    cut = rf"regexp_split_to_array(t, '[.!?](?:[{blank}]|$)|\n[{blank}]*\n')"
    return rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w, {t} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, len(list_filter({cut}, lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))) AS sentences, len(list_filter(w, lambda x: length(x) >= 9)) AS long_words FROM d)
SELECT doc_id FROM c WHERE len(w) >= 60 AND len(w) >= 24 * sentences AND 10 * long_words >= 3 * len(w)"""


SQL: dict[str, str] = {
    "p1_found": f"{_RECORDS} SELECT min(g.keep_doc_id) AS keep_doc_id, r.doc_id AS dup_doc_id FROM r JOIN g ON r.t = g.t AND r.p = g.p AND r.c = g.c WHERE r.doc_id <> g.keep_doc_id GROUP BY r.doc_id",
    "p1_copies": f"{_RECORDS} SELECT keep_doc_id, copies FROM g",
    "p2_found": f"{_SPANS} SELECT doc_id, span_start, span_end FROM z",
    "p2_shared_share": f"""{_SPANS}, y AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS c, count(*) AS n FROM z GROUP BY doc_id),
e AS (SELECT doc_id, CAST(max(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM documents GROUP BY doc_id)
SELECT e.doc_id, e.n_chars, CAST(coalesce(y.c, 0) AS BIGINT) AS shared_chars, CAST(coalesce(y.n, 0) AS BIGINT) AS n_spans, CASE WHEN e.n_chars > 0 THEN coalesce(y.c, 0) / e.n_chars ELSE 0.0 END AS shared_share
FROM e LEFT JOIN y ON e.doc_id = y.doc_id""",
    "p4_found": _PAIRS,
    "p4_groups": _GROUPS,
    "p5_found": _REPETITIVE,
    "p6_found": _LEAKS,
    "p8_found": _sentences(),
}
