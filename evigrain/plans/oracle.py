"""The same results in plain SQL, written apart from the operators: steps that build on each other, for DuckDB.

``sql(select)`` puts before a final select the steps that it names, directly or through others.
"""

from __future__ import annotations

import re

from evigrain.functions import fixed
from evigrain.sources.tables import BLANKS

_SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_W = "[\\p{L}\\p{N}_]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def ref(c: str) -> str:
    return f"nullif(lower(trim({c}, '{BLANKS}')), '')"


def fold(c: str) -> str:
    return f"replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ')"


def instant(c: str) -> str:
    """An ISO date or date-time, in UTC where it has no offset, as a UTC time; else null."""
    t = f"trim({c}, '{BLANKS}')"
    day, clock = "\\d{4}-\\d{2}-\\d{2}", "[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?"
    return (
        f"make_timestamp(epoch_us(TRY_CAST(CASE WHEN regexp_full_match({t}, '{day}') THEN {t} || 'T00:00:00Z' WHEN regexp_full_match({t}, '{day}[T ]\\d{{2}}') THEN {t} || ':00:00Z' "
        f"WHEN regexp_full_match({t}, '{day}{clock}') THEN {t} || 'Z' WHEN regexp_full_match({t}, '{day}{clock}(Z|[+-]\\d{{2}}(:?\\d{{2}})?)') THEN {t} END AS TIMESTAMPTZ)))"
    )


def stems(t: str) -> str:
    """A list of a token and its light stems, nulls among them."""
    end = lambda s, k, add="": f"CASE WHEN length({t}) > 4 AND suffix({t}, '{s}') THEN left({t}, length({t}) - {k}){add} END"
    return f"[{t}, {end('ing', 3)}, {end('ing', 3, chr(32) + '|| ' + chr(39) + 'e' + chr(39))}, {end('ed', 2)}, {end('es', 1)}, {end('es', 2)}, CASE WHEN length({t}) > 3 AND suffix({t}, 's') AND NOT (length({t}) > 4 AND suffix({t}, 'es')) THEN left({t}, length({t}) - 1) END, {end('er', 2)}]"


def estimate(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_W}+|[^\\p{{L}}\\p{{N}}_{_SPACE}]'))"


def micros(c: str) -> str:
    return f"CAST(round({c} * 1000000) AS BIGINT)"


NOW = "TIMESTAMP '2026-01-01'"
_STATUS = f"""coalesce({fold("CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.status') END")}, '')"""
_RENDER = "'[GENE ' || unit_id || '] ' || label || chr(10) || content || chr(10) || '[CITATION ' || source_location || ' | ' || source_id || ' | confidence=' || printf('%.2f', confidence) || ']'"
_FACETS = lambda c: f"list_sort(list_distinct({c}))"

STEPS = {
    "u": f"""
SELECT id AS unit_id, coalesce({ref("locus_id")}, '') AS subject_id, coalesce(label, '') AS label, coalesce(kind, '') AS kind, coalesce(content, '') AS content, coalesce(summary, '') AS summary,
  coalesce({ref("source_id")}, '') AS source_id, coalesce(source_location, '') AS source_location, coalesce(community, '') AS community, coalesce(confidence, 1.0) AS confidence, valid_from, valid_to,
  content_hash, coalesce(active, true) AS active, created_at, ingest_seq, metadata_json,
  CASE WHEN {_STATUS} IN {_in(fixed.STATUS_HISTORICAL)} THEN 'historical' WHEN {_STATUS} IN {_in(fixed.STATUS_CURRENT)} THEN 'current'
    WHEN coalesce(valid_to, '') <> '' AND NOT coalesce({instant("valid_to")} > {NOW}, false) THEN 'historical'
    WHEN coalesce(valid_from, '') <> '' AND coalesce(valid_to, '') = '' THEN 'current' ELSE 'unknown' END AS state
FROM (SELECT * FROM genes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC NULLS LAST) = 1)""",
    "r": f"""
SELECT id AS relation_id, {ref("source_id")} AS source_id, {ref("target_id")} AS target_id, coalesce(relation, 'related_to') AS relation, coalesce(confidence, 1.0) AS confidence
FROM (SELECT * FROM relations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC NULLS LAST) = 1)""",
    "s": """
SELECT id AS source_id, path, content_hash, version, created_at, coalesce(active, false) AS active FROM sources WHERE id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, active DESC NULLS LAST, version DESC NULLS LAST, path DESC NULLS LAST, content_hash DESC NULLS LAST) = 1""",
    "ev": """
SELECT event_id AS seq, 'evt:' || event_id AS event_id, CASE event_type WHEN 'purchase' THEN 'feedback.accepted' WHEN 'error' THEN 'feedback.rejected' WHEN 'signup' THEN 'mark.suppressed'
  WHEN 'view' THEN 'mark.unsuppressed' WHEN 'click' THEN 'gene.ingested' ELSE event_type END AS event_type, u.unit_id, value, ts AS created_at
FROM events LEFT JOIN u ON u.ingest_seq = user_id""",
    "mk": """
SELECT unit_id, count(*) FILTER (event_type = 'feedback.accepted') AS successes, count(*) FILTER (event_type = 'feedback.rejected') AS failures,
  round(greatest(-0.1, least(0.1, ((successes + 1) / (successes + failures + 2) - 0.5) * 0.2)), 10) AS boost,
  coalesce(arg_max(event_type = 'mark.suppressed', seq) FILTER (event_type LIKE 'mark.%'), false) AS suppressed
FROM ev WHERE unit_id IS NOT NULL GROUP BY unit_id""",
    # questions
    "q": "SELECT question_id, category, coalesce(query, '') AS query, coalesce(budget, 1200) AS budget, expected_gene_ids FROM questions",
    "qt": f"""
SELECT question_id, {fold("t")} AS t, min(i) AS i FROM (SELECT question_id, unnest(regexp_extract_all(query, '{_W}+')) AS t, generate_subscripts(regexp_extract_all(query, '{_W}+'), 1) AS i FROM q) WHERE length(t) > 1 GROUP BY ALL""",
    "qraw": f"""
SELECT question_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT question_id, regexp_extract_all(query, '-?{_W}+(?:[.-]{_W}+)*') AS l FROM q)""",
    "qpos": f"""
SELECT question_id, i, {fold("t")} AS t, min(j) AS j FROM (SELECT question_id, i, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM (SELECT question_id, i, regexp_extract_all(raw, '{_W}+') AS l FROM qraw WHERE NOT (prefix(raw, '-') AND length(raw) > 1)))
WHERE length(t) > 1 GROUP BY ALL HAVING {fold("t")} NOT IN {_in(fixed.STOPWORDS)}""",
    "qneg": f"""
SELECT DISTINCT question_id, form FROM (SELECT question_id, unnest({stems("t")}) AS form FROM (SELECT question_id, {fold("t")} AS t FROM (SELECT question_id, unnest(regexp_extract_all(raw[2:], '{_W}+')) AS t FROM qraw WHERE prefix(raw, '-') AND length(raw) > 1) WHERE length(t) > 1))
WHERE length(form) > 1""",
    "qbody": f"""
SELECT q.question_id, CASE WHEN bool_or({fold("t")} IN {_in(fixed.NOISE)}) THEN substr(any_value(query), instr(any_value(query), ':') + 1) ELSE any_value(query) END AS body
FROM q LEFT JOIN (SELECT question_id, unnest(regexp_extract_all(left(query, instr(query, ':') - 1), '{_W}+')) AS t FROM q WHERE instr(query, ':') > 0) p ON p.question_id = q.question_id AND length(t) > 1 GROUP BY q.question_id""",
    "qseg": f"""
SELECT question_id, k, t, min(i) AS i FROM (
  SELECT question_id, k, {fold("t")} AS t, i FROM (SELECT question_id, k, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
    SELECT question_id, k, regexp_extract_all(seg, '{_W}+') AS l FROM (SELECT question_id, unnest(p) AS seg, generate_subscripts(p, 1) AS k FROM (SELECT question_id, regexp_split_to_array(body, '(?i)[{_SPACE}]+(?:and|e)[{_SPACE}]+|[,;]') AS p FROM qbody))))
  WHERE length(t) > 1)
WHERE t NOT IN {_in([*fixed.STOPWORDS, *fixed.NOISE])} GROUP BY ALL""",
    "qinstead": f"""
SELECT q.question_id, coalesce((SELECT list(t ORDER BY i, j) FROM qpos p WHERE p.question_id = q.question_id AND t NOT IN {_in(fixed.NOISE)}), (SELECT list(t ORDER BY i, j) FROM qpos p WHERE p.question_id = q.question_id),
  (SELECT list(t ORDER BY i) FROM qt WHERE qt.question_id = q.question_id), []) AS tokens FROM q WHERE q.question_id NOT IN (SELECT question_id FROM qseg)""",
    "f": """
SELECT question_id, tokens, row_number() OVER (PARTITION BY question_id ORDER BY k) AS facet_id, array_to_string(tokens, ' ') AS facet FROM (
  SELECT question_id, tokens, min(k) AS k FROM (SELECT question_id, k, list(t ORDER BY i) AS tokens FROM qseg GROUP BY ALL) GROUP BY ALL UNION ALL SELECT question_id, tokens, 1 FROM qinstead)
QUALIFY facet_id <= 8""",
    "ff": f"SELECT DISTINCT question_id, facet_id, form FROM (SELECT question_id, facet_id, unnest({stems('t')}) AS form FROM (SELECT question_id, facet_id, unnest(tokens) AS t FROM f)) WHERE length(form) > 1",
    "fc": f"SELECT DISTINCT question_id, facet_id, form FROM (SELECT question_id, facet_id, unnest({stems('tokens[1]')}) AS form FROM f) WHERE length(form) > 1",
    "qx": f"""
SELECT q.*, (SELECT count(*) FROM f WHERE f.question_id = q.question_id) AS facet_count, (SELECT count(DISTINCT form) FROM ff WHERE ff.question_id = q.question_id) AS term_count,
  CASE WHEN EXISTS (FROM qt WHERE qt.question_id = q.question_id AND t IN {_in(fixed.TASK_CODE)}) THEN 'code' WHEN EXISTS (FROM qt WHERE qt.question_id = q.question_id AND t IN {_in(fixed.TASK_DECISION)}) OR contains({fold("query")}, 'por que') THEN 'decision'
    WHEN EXISTS (FROM qt WHERE qt.question_id = q.question_id AND t IN {_in(fixed.TASK_TEMPORAL)}) THEN 'temporal' ELSE 'docs' END AS task,
  CASE WHEN EXISTS (FROM qt WHERE qt.question_id = q.question_id AND t IN {_in(fixed.CURRENT_WORDS)}) THEN 'current' WHEN EXISTS (FROM qt WHERE qt.question_id = q.question_id AND t IN {_in(fixed.HISTORICAL_WORDS)}) THEN 'historical' ELSE 'current' END AS mode
FROM q""",
    # channels
    "ut": f"SELECT DISTINCT unit_id, {fold('t')} AS t FROM (SELECT unit_id, unnest(regexp_extract_all(concat_ws(' ', label, summary, content), '{_W}+')) AS t FROM u) WHERE length(t) > 1",
    "uf": f"SELECT DISTINCT unit_id, form FROM (SELECT unit_id, unnest({stems('t')}) AS form FROM ut) WHERE length(form) > 1",
    "un": "SELECT unit_id, count(*) AS n FROM uf GROUP BY 1",
    "c1": """
SELECT question_id, facet_id, unit_id, row_number() OVER (PARTITION BY question_id, facet_id ORDER BY ingest_seq, unit_id) AS rank
FROM f JOIN u ON active AND (contains(lower(label), facet) OR contains(lower(unit_id), facet)) QUALIFY rank <= 50""",
    "it": "SELECT unit_id, unnest(regexp_extract_all(strip_accents(lower(concat_ws(' ', label, summary, content))), '[\\p{L}\\p{N}]+')) AS term FROM u",
    "itf": "SELECT unit_id, term, count(*) AS tf FROM it GROUP BY ALL",
    "il": "SELECT u.unit_id, active, count(term) AS len FROM u LEFT JOIN it USING (unit_id) GROUP BY ALL",
    "fi": "SELECT DISTINCT question_id, facet_id, unnest(regexp_extract_all(strip_accents(lower(facet)), '[\\p{L}\\p{N}]+')) AS term FROM f",
    "idf": "SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS df FROM itf GROUP BY 1), (SELECT count(*) AS n FROM u)",
    "c2": """
SELECT question_id, facet_id, unit_id, score, row_number() OVER (PARTITION BY question_id, facet_id ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT question_id, facet_id, unit_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM il)))), 10) AS score
  FROM fi JOIN idf USING (term) JOIN itf USING (term) JOIN il USING (unit_id) WHERE active GROUP BY ALL)
QUALIFY rank <= 50""",
    "c3": """
SELECT question_id, facet_id, unit_id, shared, score, row_number() OVER (PARTITION BY question_id, facet_id ORDER BY shared DESC, score DESC, unit_id) AS rank FROM (
  SELECT question_id, facet_id, unit_id, count(*) AS shared, round(count(*) / (any_value(n) + any_value(m) - count(*)), 10) AS score
  FROM ff JOIN uf USING (form) JOIN un USING (unit_id) JOIN u USING (unit_id) JOIN (SELECT question_id, facet_id, count(*) AS m FROM ff GROUP BY ALL) USING (question_id, facet_id) WHERE active GROUP BY ALL)
QUALIFY rank <= 50""",
    "rk": "SELECT question_id, facet_id, unit_id, rank, 0 AS channel FROM c1 UNION ALL SELECT question_id, facet_id, unit_id, rank, 1 FROM c2 UNION ALL SELECT question_id, facet_id, unit_id, rank, 2 FROM c3",
    "pf": "SELECT question_id, facet_id, unit_id, sum(1.0 / (60 + rank)) AS s FROM rk GROUP BY ALL",
    "pt": "SELECT question_id, facet_id, unit_id FROM pf QUALIFY row_number() OVER (PARTITION BY question_id, facet_id ORDER BY round(s, 10) DESC, unit_id) <= 2",
    "fused0": """
SELECT question_id, unit_id, round(sum(s), 10) AS score, list_sort(list(facet_id)) AS facets, bool_or(pt.unit_id IS NOT NULL) AS protected FROM pf LEFT JOIN pt USING (question_id, facet_id, unit_id) GROUP BY question_id, unit_id""",
    "fbq": f"""
SELECT q.question_id, CASE WHEN EXISTS (FROM qpos p WHERE p.question_id = q.question_id) THEN (SELECT string_agg(t, ' ') FROM qpos p WHERE p.question_id = q.question_id) ELSE query END AS text FROM q WHERE question_id NOT IN (SELECT question_id FROM fused0)""",
    "fbf": f"SELECT DISTINCT question_id, form FROM (SELECT question_id, unnest({stems('t')}) AS form FROM (SELECT question_id, {fold('t')} AS t FROM (SELECT question_id, unnest(regexp_extract_all(text, '{_W}+')) AS t FROM fbq) WHERE length(t) > 1)) WHERE length(form) > 1",
    "fb": """
SELECT question_id, unit_id FROM (SELECT question_id, unit_id, count(*) AS shared, any_value(n) AS n, any_value(m) AS m FROM fbf JOIN uf USING (form) JOIN un USING (unit_id) JOIN u USING (unit_id) JOIN (SELECT question_id, count(*) AS m FROM fbf GROUP BY 1) USING (question_id) WHERE active GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, round(shared / (n + m - shared), 10) DESC, unit_id) <= 50""",
    "fused": "SELECT * FROM fused0 UNION ALL SELECT question_id, unit_id, round(1.0 / 61, 10), [1], true FROM fb",
    # graph: edges from both ends
    "e": """
SELECT source_id AS a, target_id AS b, relation, confidence FROM r WHERE source_id <> target_id UNION ALL SELECT target_id, source_id, relation, confidence FROM r WHERE source_id <> target_id""",
    "g1": f"SELECT question_id, b AS unit_id, CAST(sum(CAST(score * e.confidence * 0.55 AS DECIMAL(38,16))) AS DOUBLE) AS gain, {_FACETS('flatten(list(facets))')} AS facets, list_sort(list_distinct(list('graph:' || relation || ':h1'))) AS channels FROM fused JOIN e ON a = unit_id WHERE b IN (SELECT unit_id FROM u WHERE active) GROUP BY ALL",
    "h1": f"""
SELECT question_id, unit_id, round(coalesce(x.score, 0) + coalesce(gain, 0), 10) AS score, {_FACETS("list_concat(x.facets, g1.facets)")} AS facets, coalesce(protected, false) AS protected, CASE WHEN x.score IS NULL THEN 1 ELSE 0 END AS depth, coalesce(channels, []) AS channels
FROM fused x FULL JOIN g1 USING (question_id, unit_id)""",
    "g2": f"SELECT question_id, b AS unit_id, CAST(sum(CAST(score * e.confidence * (0.55::DOUBLE * 0.55::DOUBLE) AS DECIMAL(38,16))) AS DOUBLE) AS gain, {_FACETS('flatten(list(facets))')} AS facets FROM h1 JOIN e ON a = unit_id WHERE depth = 1 AND b IN (SELECT unit_id FROM u WHERE active) GROUP BY ALL",
    "h2": f"""
SELECT question_id, unit_id, round(coalesce(x.score, 0) + coalesce(gain, 0), 10) AS score, {_FACETS("list_concat(x.facets, g2.facets)")} AS facets, coalesce(protected, false) AS protected, coalesce(depth, 2) AS depth
FROM h1 x FULL JOIN g2 USING (question_id, unit_id)""",
    # versions
    "rep": """
SELECT h2.question_id, h2.unit_id AS old_id, n.unit_id, h2.score, h2.facets, h2.protected FROM h2 JOIN qx USING (question_id) JOIN u o USING (unit_id) JOIN u n ON n.subject_id = o.subject_id
WHERE mode = 'current' AND o.state = 'historical' AND n.active AND n.state = 'current'""",
    "cand": f"""
SELECT question_id, unit_id, round(coalesce(h2.score, 0) + coalesce(gain, 0), 10) AS score, {_FACETS("list_concat(h2.facets, v.facets)")} AS facets, coalesce(h2.protected, false) OR coalesce(v.protected, false) AS protected
FROM h2 FULL JOIN (SELECT question_id, unit_id, CAST(sum(CAST(score * 1.08 AS DECIMAL(38,16))) AS DOUBLE) AS gain, flatten(list(facets)) AS facets, bool_or(protected) AS protected FROM rep GROUP BY question_id, unit_id) v USING (question_id, unit_id)""",
    # scoring
    "qw": "SELECT DISTINCT question_id, form FROM ff",
    "mt": "SELECT question_id, unit_id, list_sort(list(form)) AS matched FROM cand JOIN qw USING (question_id) JOIN uf USING (unit_id, form) GROUP BY ALL",
    "bar": "SELECT question_id, unit_id, list_sort(list(form)) AS barred FROM cand JOIN qneg USING (question_id) JOIN uf USING (unit_id, form) GROUP BY ALL",
    "core": "SELECT question_id, unit_id, list_sort(list(DISTINCT facet_id)) AS core FROM cand JOIN fc USING (question_id) JOIN uf USING (unit_id, form) WHERE list_contains(facets, facet_id) GROUP BY ALL",
    "cost": f"SELECT unit_id, {estimate(_RENDER)} AS tokens FROM u",
    "scored": f"""
SELECT question_id, unit_id, u.subject_id, round(c.score * (0.5 + 0.5 * greatest(0, least(1, confidence))) * (0.5 + 0.5 * len(coalesce(matched, [])) / greatest(1, term_count))
    * CASE WHEN s.active THEN 1.03 WHEN s.source_id IS NOT NULL THEN 0.92 ELSE 1 END
    * CASE WHEN {" OR ".join(f"task = '{t}' AND {fold('kind')} IN {_in(k)}" for t, k in fixed.TASK_KINDS.items())} THEN 1.08 ELSE 1 END * (1 + coalesce(boost, 0)), 10) AS score,
  facets, coalesce(core, []) AS core, coalesce(matched, []) AS matched, coalesce(barred, []) AS barred, protected, tokens, budget, facet_count, state,
  CASE WHEN len(coalesce(barred, [])) > 0 THEN 'repressor matched' WHEN mode = 'current' AND state = 'historical' THEN 'historical allele superseded' WHEN suppressed THEN 'explicitly suppressed' END AS excluded
FROM cand c JOIN qx USING (question_id) JOIN u USING (unit_id) JOIN cost USING (unit_id) LEFT JOIN s USING (source_id) LEFT JOIN mk USING (unit_id)
LEFT JOIN mt USING (question_id, unit_id) LEFT JOIN bar USING (question_id, unit_id) LEFT JOIN core USING (question_id, unit_id)""",
    "floor": "SELECT question_id, max(score) * 0.7 AS floor FROM scored WHERE excluded IS NULL GROUP BY 1",
    "th": """
SELECT scored.* EXCLUDE (excluded), round(floor, 10) AS floor, CASE WHEN excluded IS NOT NULL THEN excluded WHEN score + 1e-12 < floor AND NOT protected AND len(core) = 0 THEN 'expression threshold' END AS excluded
FROM scored LEFT JOIN floor USING (question_id)""",
    "tw": """
SELECT question_id, form AS term, round(ln((1 + n) / (1 + coalesce(df, 0))) + 1, 10) AS weight FROM (SELECT question_id, count(*) AS n FROM th WHERE excluded IS NULL GROUP BY 1) JOIN qw USING (question_id)
LEFT JOIN (SELECT question_id, form, count(*) AS df FROM (SELECT question_id, unnest(matched) AS form FROM th WHERE excluded IS NULL) GROUP BY ALL) USING (question_id, form)""",
}

# --- packing: recursive steps stand last, in one statement ---------------------------------------------------------

COVERAGE = """
, ct AS MATERIALIZED (SELECT unit_id, list_distinct(list_transform(list_filter(regexp_extract_all(content, '%(w)s+'), lambda t: length(t) > 1), lambda t: %(fold)s)) AS terms FROM u),
cw AS MATERIALIZED (SELECT question_id, unit_id, score, tokens, facets, core, budget, facet_count, terms,
  coalesce((SELECT list({'t': term, 'w': weight}) FROM tw WHERE tw.question_id = th.question_id AND list_contains(matched, term)), []) AS mw FROM th JOIN ct USING (unit_id) WHERE excluded IS NULL AND tokens <= budget),
p AS (
  SELECT *, 0.0::DOUBLE AS sim, []::BIGINT[] AS gf, []::BIGINT[] AS gc, []::VARCHAR[] AS gt, 0::BIGINT AS used, 1 AS step FROM cw
  UNION ALL
  SELECT question_id, unit_id, score, tokens, facets, core, budget, facet_count, terms, mw,
    greatest(sim, CASE WHEN len(terms) + len(w.terms_) > 0 THEN len(list_intersect(terms, w.terms_)) / (len(terms) + len(w.terms_) - len(list_intersect(terms, w.terms_))) ELSE 0 END),
    list_concat(gf, w.facets_), list_concat(gc, w.core_), list_concat(gt, w.t_), used + w.tokens_, step + 1
  FROM (SELECT *, first_value({'unit_': unit_id, 'terms_': terms, 'facets_': facets, 'core_': core, 't_': list_transform(mw, lambda x: x.t), 'tokens_': tokens}) OVER (PARTITION BY question_id ORDER BY %(utility)s DESC, score DESC, tokens, unit_id) AS w FROM p)
  WHERE unit_id <> w.unit_ AND used + w.tokens_ + tokens <= budget
), packed AS (
  SELECT question_id, unit_id, step AS rank, %(utility)s AS utility FROM p QUALIFY row_number() OVER (PARTITION BY question_id, step ORDER BY utility DESC, score DESC, tokens, unit_id) = 1
)
""" % {
    "w": _W,
    "fold": fold("t"),
    "utility": "round((score * (1 - 0.25 * sim) + 0.010 * len(list_filter(facets, lambda x: NOT list_contains(gf, x))) / greatest(1, facet_count) + 0.018 * len(list_filter(core, lambda x: NOT list_contains(gc, x)))"
    " + 0.004 * coalesce(list_sum(list_transform(list_filter(mw, lambda x: NOT list_contains(gt, x.t)), lambda x: x.w)), 0)) / (1 + 0.15 * tokens / greatest(1, budget)), 10)",
}

#: Packing in the order of a score: ``ordered`` needs (question_id, unit_id, tokens, budget, at), at counting from 1.
IN_ORDER = """
, w AS (
  SELECT question_id, 0::BIGINT AS at, 0::BIGINT AS used, 0 AS rank, NULL::VARCHAR AS unit_id FROM (SELECT DISTINCT question_id FROM ordered)
  UNION ALL
  SELECT w.question_id, o.at, w.used + o.tokens, w.rank + 1, o.unit_id FROM w JOIN LATERAL (SELECT x.at, x.tokens, x.unit_id FROM ordered x WHERE x.question_id = w.question_id AND x.at > w.at AND w.used + x.tokens <= x.budget ORDER BY x.at LIMIT 1) o ON true
), packed AS (SELECT question_id, unit_id, rank FROM w WHERE rank > 0)
"""


def sql(select: str, extra: str = "", steps: dict[str, str] | None = None) -> str:
    """``select`` behind the steps that it and ``extra`` (recursive steps, begun with a comma) name."""
    own = STEPS | (steps or {})
    need: dict[str, None] = {}
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in own:
            if name not in begun and re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                begun.add(name)
                visit(own[name])
                need[name] = None

    visit(extra)
    visit(select)
    head = ", ".join(f"{n} AS MATERIALIZED ({own[n]})" for n in need)
    if not head:
        return select
    # ties are rounded up, whatever the last bits of a sum say
    head, extra, select = (x.replace(", 10)", " + 1.0005e-13, 10)") for x in (head, extra, select))
    return f"WITH {'RECURSIVE ' if extra else ''}{head} {extra} {select}"
