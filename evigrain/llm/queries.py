"""Queries over the test tables by the operators of this subpackage, and their SQL where SQL can tell."""

from __future__ import annotations

from importlib import import_module

#: module of each query
_QUERIES = {
    "p1_budget": "budget",
    "p1_estimates": "budget",
    "p2_found": "neardup",
    "p2_groups": "neardup",
    "p3_found": "split",
    "p3_pieces": "split",
    "p6_ids": "encode",
    "p7_found": "leak",
    "p7_removals": "leak",
    "p7_spans": "leak",
    "p8_found": "garbled",
    "p8_repaired": "garbled",
}


def queries():
    return {q: getattr(import_module(f"evigrain.llm.{m}"), q) for q, m in _QUERIES.items()}


def oracle_sql():
    return {
        "p2_found": f"{_P2} SELECT gene_id_a, gene_id_b FROM pairs",
        "p2_groups": f"{_P2}{_P2_GROUPS}",
        "p3_found": "SELECT DISTINCT id AS gene_id FROM genes WHERE length(content) > 1500",
        "p7_found": f"{_P7} SELECT DISTINCT doc_id, question_id FROM hits",
        "p7_spans": f"{_P7}{_P7_SPANS} SELECT spans.doc_id, question_id, CAST(a AS INT) AS first_word, CAST(e AS INT) AS last_word, CAST(x.char_from AS INT) AS char_from, CAST(y.char_to AS INT) AS char_to FROM spans JOIN w x ON x.doc = spans.doc AND x.i = a JOIN w y ON y.doc = spans.doc AND y.i = e",
        "p7_removals": f"{_P7}{_P7_SPANS}{_P7_REMOVALS}",
    }


# words by rank of rarity; two similar sets share one of the first n - ceil(0.8 n) + 1 words of each
_P2 = """
WITH RECURSIVE g AS MATERIALIZED (SELECT id, any_value(nullif(lower(trim(locus_id)), '')) AS locus, any_value(content) AS content FROM genes WHERE id IS NOT NULL GROUP BY id),
w AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}_]{2,}'), lambda x: lower(x)))) AS words FROM g WHERE content IS NOT NULL),
s AS MATERIALIZED (SELECT id, locus, words, len(words) AS n FROM w JOIN g USING (id) WHERE len(words) > 0),
e AS MATERIALIZED (SELECT id, n, unnest(words) AS word FROM s),
f AS MATERIALIZED (SELECT word, count(*) AS df FROM e GROUP BY word),
p AS MATERIALIZED (SELECT id, word FROM e JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, word) <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id < b.id),
pairs AS MATERIALIZED (
  SELECT a AS gene_id_a, b AS gene_id_b FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b
  WHERE x.locus <> y.locus AND 5 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n - len(list_intersect(x.words, y.words))))
"""

_P2_GROUPS = """
, twoway AS MATERIALIZED (SELECT gene_id_a AS a, gene_id_b AS b FROM pairs UNION ALL SELECT gene_id_b, gene_id_a FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS r FROM twoway UNION SELECT twoway.b, reach.r FROM reach JOIN twoway ON twoway.a = reach.id),
root AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id),
class AS (SELECT words, min(id) AS class_id FROM s GROUP BY words)
SELECT g.id AS gene_id, class_id, group_id, (SELECT count(*) FROM twoway WHERE twoway.a = g.id) AS links FROM g LEFT JOIN s ON s.id = g.id LEFT JOIN class ON class.words = s.words LEFT JOIN root ON root.id = g.id
"""

# each piece is a word with what stands before it, so that the lengths so far give its place
_P7 = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS doc, regexp_extract_all(text, '[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+') AS l FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, doc, i, char_to - length(word) AS char_from, char_to, lower(word) AS word FROM (
  SELECT doc_id, doc, i, regexp_extract(piece, '[\\p{L}\\p{N}]+$') AS word, sum(length(piece)) OVER (PARTITION BY doc ORDER BY i) AS char_to FROM (SELECT doc_id, doc, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS i FROM d))),
q AS (SELECT question_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT question_id, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+') AS l FROM questions)),
dp AS (SELECT doc_id, doc, i, list(word) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS phrase FROM w),
qp AS (SELECT DISTINCT question_id, phrase FROM (SELECT question_id, list(word) OVER (PARTITION BY question_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS phrase FROM q) WHERE len(phrase) = 8),
hits AS MATERIALIZED (SELECT doc_id, doc, question_id, i FROM dp JOIN qp USING (phrase) WHERE len(phrase) = 8)
"""

_P7_SPANS = """
, n AS (SELECT *, CASE WHEN i <= lag(i + 7) OVER (PARTITION BY doc, question_id ORDER BY i) + 1 THEN 0 ELSE 1 END AS new FROM hits),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc, question_id ORDER BY i) AS span FROM n),
spans AS MATERIALIZED (SELECT doc_id, doc, question_id, min(i) AS a, max(i) + 7 AS e FROM k GROUP BY doc_id, doc, question_id, span)
"""

_P7_REMOVALS = """
, c AS (SELECT spans.doc_id, spans.doc, question_id, x.char_from, y.char_to FROM spans JOIN w x ON x.doc = spans.doc AND x.i = a JOIN w y ON y.doc = spans.doc AND y.i = e),
m AS (SELECT *, CASE WHEN char_from <= max(char_to) OVER (PARTITION BY doc ORDER BY char_from, char_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
o AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY char_from, char_to ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT doc_id, CAST(min(char_from) AS INT) AS char_from, CAST(max(char_to) AS INT) AS char_to, count(DISTINCT question_id) AS questions FROM o GROUP BY doc_id, doc, part
"""
