"""All queries over the test tables by the operators of the core, and their SQL."""

from __future__ import annotations

from evigrain.operators import history, orphans
from evigrain.plans import queries as Q
from evigrain.plans.oracle import ref


def flagship(spark, folder):
    return Q.QUERIES["retrieve"](spark, folder)


def queries():
    return Q.QUERIES | {f.__name__: f for f in (orphans.p4_found, orphans.p4_totals, orphans.p4_cascade, history.p5_found, history.p5_history)}


def oracle_sql():
    return Q.ORACLE | {"p4_found": _P4_FOUND, "p4_totals": _P4_TOTALS, "p4_cascade": _P4_CASCADE, "p5_found": _P5_FOUND, "p5_history": _P5_HISTORY}


_P4_REFS = f"""
WITH g AS (
  SELECT id, min(created_at) AS first, arg_max(created_at, ingest_seq) AS created_at, arg_max(active, ingest_seq) AS active, arg_max(coalesce({ref("source_id")}, ''), ingest_seq) AS ref FROM genes GROUP BY id
), s AS (SELECT id, min(created_at) AS since FROM sources GROUP BY id),
r AS (
  SELECT id, arg_max(created_at, ingest_seq) AS created_at, arg_max(coalesce({ref("source_id")}, ''), ingest_seq) AS source_id, arg_max(coalesce({ref("target_id")}, ''), ingest_seq) AS target_id FROM relations GROUP BY id
), e AS (
  SELECT 'source_id' AS ref_field, id, created_at, source_id AS ref FROM r UNION ALL SELECT 'target_id', id, created_at, target_id FROM r
), x AS (
  SELECT 'relations' AS ref_table, ref_field, e.id AS record_id, e.created_at, e.ref, CASE WHEN g.id IS NULL THEN 'absent' WHEN NOT g.active THEN 'deleted' WHEN g.first > e.created_at THEN 'later' END AS reason FROM e LEFT JOIN g ON g.id = e.ref WHERE e.ref <> ''
  UNION ALL SELECT 'genes', 'source_id', g.id, g.created_at, g.ref, CASE WHEN s.id IS NULL THEN 'absent' WHEN s.since > g.created_at THEN 'later' END FROM g LEFT JOIN s ON s.id = g.ref WHERE g.ref <> ''
), y AS (SELECT x.*, reason IS NULL AND ref_table = 'relations' AND ref IN (SELECT record_id FROM x z WHERE z.ref_table = 'genes' AND z.reason IS NOT NULL) AS inherited FROM x)
"""
_P4_FOUND = _P4_REFS + "SELECT ref_table, ref_field, record_id FROM x WHERE reason IS NOT NULL"
_P4_TOTALS = _P4_REFS + """SELECT ref_table, ref_field, strftime(created_at, '%Y-%m') AS month, count(*) AS refs, count(reason) AS direct, count(*) FILTER (reason = 'absent') AS absent, count(*) FILTER (reason = 'deleted') AS deleted,
  count(*) FILTER (reason = 'later') AS later, count(*) FILTER (inherited) AS inherited FROM y GROUP BY ALL"""
_P4_CASCADE = _P4_REFS + "SELECT ref_table, record_id, CASE WHEN count(reason) > 0 THEN 0 ELSE 1 END AS level FROM y WHERE reason IS NOT NULL OR inherited GROUP BY ALL"

_P5_FOUND = """
WITH t AS (
  SELECT id, arg_max(lower(trim(locus_id)), ingest_seq) AS locus_id, max(ingest_seq) AS seq, arg_max(lower(trim(source_id)), ingest_seq) AS ref,
         arg_max(coalesce(lower(trim(kind)), '') || '|' || trim(regexp_replace(content, '\\s+', ' ', 'g')), ingest_seq) AS state,
         max(make_timestamp(epoch_us(TRY_CAST(CASE WHEN regexp_full_match(trim(valid_from), '\\d{4}-\\d\\d-\\d\\d') THEN trim(valid_from) || 'T00:00:00Z'
             WHEN regexp_full_match(trim(valid_from), '\\d{4}-\\d\\d-\\d\\d[T ][\\d:.]+') THEN trim(valid_from) || 'Z'
             WHEN regexp_full_match(trim(valid_from), '\\d{4}-\\d\\d-\\d\\d[T ][\\d:.]+(Z|[+-][\\d:]+)') THEN trim(valid_from) END AS TIMESTAMPTZ)))) AS start,
         max(make_timestamp(epoch_us(TRY_CAST(CASE WHEN regexp_full_match(trim(valid_to), '\\d{4}-\\d\\d-\\d\\d') THEN trim(valid_to) || 'T00:00:00Z'
             WHEN regexp_full_match(trim(valid_to), '\\d{4}-\\d\\d-\\d\\d[T ][\\d:.]+') THEN trim(valid_to) || 'Z'
             WHEN regexp_full_match(trim(valid_to), '\\d{4}-\\d\\d-\\d\\d[T ][\\d:.]+(Z|[+-][\\d:]+)') THEN trim(valid_to) END AS TIMESTAMPTZ)))) AS until
  FROM genes GROUP BY id
), k AS (
  SELECT t.* FROM t LEFT JOIN (SELECT id, max(version) AS version FROM sources GROUP BY id) s ON s.id = t.ref
  WHERE start IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY locus_id, start ORDER BY version DESC NULLS LAST, seq DESC, t.id) = 1
), n AS (
  SELECT *, lag(state) OVER w IS DISTINCT FROM state AS new FROM k WINDOW w AS (PARTITION BY locus_id ORDER BY start)
), i AS (
  SELECT *, sum(new::int) OVER (PARTITION BY locus_id ORDER BY start) AS version FROM n
), v AS (
  SELECT locus_id, version, min(start) AS first, max(start) AS last, max({'start': start, 'until': until}).until AS until FROM i GROUP BY ALL
), x AS (
  SELECT *, lead(first) OVER (PARTITION BY locus_id ORDER BY version) AS after FROM v
)
SELECT locus_id, strftime(first, '%Y-%m-%d') AS version_from,
       coalesce(strftime(CASE WHEN until > last AND (after IS NULL OR until < after) THEN until ELSE after END, '%Y-%m-%d'), '9999-12-31') AS version_to
FROM x
"""

_P5_HISTORY = _P5_FOUND[: _P5_FOUND.index(", v AS (")] + """, v AS (
  SELECT locus_id, version, min(start) AS first, max(start) AS last, max({'start': start, 'until': until}).until AS until, count(*) AS gene_count, arg_min(id, start) AS gene_id FROM i GROUP BY ALL
), x AS (
  SELECT *, lead(first) OVER (PARTITION BY locus_id ORDER BY version) AS after FROM v
), c AS (SELECT id, arg_max(content, ingest_seq) AS content, nullif(arg_max(coalesce(lower(trim(kind)), ''), ingest_seq), '') AS kind FROM genes GROUP BY id)
SELECT locus_id, CAST(version AS INT) AS version, strftime(first, '%Y-%m-%d') AS version_from, coalesce(strftime(CASE WHEN until > last AND (after IS NULL OR until < after) THEN until ELSE after END, '%Y-%m-%d'), '9999-12-31') AS version_to,
  gene_id, gene_count, kind, content
FROM x JOIN c ON c.id = x.gene_id
"""
