"""One query per operator over the test tables, and the SQL that says the same.

Every query runs over whole tables. A query named in ``ORACLE`` has SQL; the others are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import questions as Q
from evigrain.functions import text as T
from evigrain.functions.numbers import r10
from evigrain.operators import audit, channels, evaluate, expansion, packing, scoring, temporal
from evigrain.plans import oracle as O
from evigrain.plans import pipeline as P
from evigrain.session import materialise, shared_folder, together
from evigrain.sources import ingest
from evigrain.sources.corpus import NOW, audit_events, corpus, held, units
from evigrain.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _units(spark, folder):
    return units(table(spark, folder, "genes"))


def _questions(spark, folder):
    return table(spark, folder, "questions")


def _plan(spark, folder):
    return P.planned(_questions(spark, folder))


def _facets(spark, folder):
    return Q.facet_rows(_plan(spark, folder))


def _joined(c):
    return F.array_join(c, " ")


# --- text ----------------------------------------------------------------------------------------------------------


@query(O.sql(f"""
SELECT unit_id, count(t) AS n, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM u LEFT JOIN (
  SELECT unit_id, {O.fold("t")} AS t, min(i) AS i FROM (SELECT unit_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT unit_id, regexp_extract_all(content, '{O._W}+') AS l FROM u)) WHERE length(t) > 1 GROUP BY ALL) USING (unit_id) GROUP BY unit_id"""))  # fmt: skip
def term_list(spark, folder):
    """Distinct terms of each unit's content in order."""
    t = _units(spark, folder).select("unit_id", T.term_list("content").alias("t"))
    return t.select("unit_id", F.size("t").cast("bigint").alias("n"), _joined("t").alias("terms"))


@query(O.sql("SELECT unit_id, count(form) AS n, coalesce(string_agg(form, ' ' ORDER BY form), '') AS forms FROM u LEFT JOIN uf USING (unit_id) GROUP BY unit_id"))
def lexical_forms(spark, folder):
    """Terms of each unit with their light stems, sorted."""
    t = _units(spark, folder).select("unit_id", F.array_sort(T.lexical_forms(T.unit_text())).alias("f"))
    return t.select("unit_id", F.size("f").cast("bigint").alias("n"), _joined("f").alias("forms"))


@query(O.sql("""
SELECT q.question_id, coalesce((SELECT string_agg(t, ' ' ORDER BY i, j) FROM qpos WHERE qpos.question_id = q.question_id), '') AS positives,
  coalesce((SELECT string_agg(form, ' ' ORDER BY form) FROM qneg WHERE qneg.question_id = q.question_id), '') AS negatives FROM q"""))  # fmt: skip
def query_tokens(spark, folder):
    """Terms asked for and forms asked away."""
    return _plan(spark, folder).select("question_id", _joined("positives").alias("positives"), _joined("negatives").alias("negatives"))


#: Every text of the corpus read as a query: signs, colons and joined words that the questions lack.
_AS_QUESTIONS = {"q": "SELECT doc_id AS question_id, coalesce(text, '') AS query FROM documents"}


def _documents_as_questions(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("query"))


@query(O.sql("""
SELECT q.question_id, coalesce((SELECT string_agg(t, ' ' ORDER BY i, j) FROM qpos WHERE qpos.question_id = q.question_id), '') AS positives,
  coalesce((SELECT string_agg(form, ' ' ORDER BY form) FROM qneg WHERE qneg.question_id = q.question_id), '') AS negatives FROM q""", steps=_AS_QUESTIONS))  # fmt: skip
def signed_terms(spark, folder):
    """The parser of questions over every document."""
    d = _documents_as_questions(spark, folder)
    return d.select("question_id", _joined(Q.positives("query")).alias("positives"), _joined(Q.negatives("query")).alias("negatives"))


@query(O.sql("SELECT question_id, facet_id, facet FROM f"))
def facet_plan(spark, folder):
    return _facets(spark, folder).select("question_id", F.col("facet_id").cast("bigint").alias("facet_id"), "facet")


@query(O.sql("SELECT question_id, facet_id, facet FROM f", steps=_AS_QUESTIONS))
def facet_plan_documents(spark, folder):
    """The facet planner over every document."""
    d = _documents_as_questions(spark, folder).select("question_id", F.posexplode(Q.facets("query")).alias("p", "t"))
    return d.select("question_id", (F.col("p") + 1).cast("bigint").alias("facet_id"), _joined("t").alias("facet"))


@query(O.sql("SELECT question_id, facet_id, coalesce(string_agg(form, ' ' ORDER BY form), '') AS core_forms FROM f LEFT JOIN fc USING (question_id, facet_id) GROUP BY ALL"))
def core_forms(spark, folder):
    return _facets(spark, folder).select("question_id", F.col("facet_id").cast("bigint").alias("facet_id"), _joined(F.array_sort("core_forms")).alias("core_forms"))


@query(O.sql("SELECT question_id, task FROM qx", steps=_AS_QUESTIONS | {"f": "SELECT NULL::BIGINT AS question_id, NULL AS facet_id", "ff": "SELECT NULL::BIGINT AS question_id, NULL AS form"}))
def task_classify(spark, folder):
    return _documents_as_questions(spark, folder).select("question_id", Q.task("query").alias("task"))


@query(O.sql("SELECT question_id, mode AS temporal_mode FROM qx", steps=_AS_QUESTIONS | {"f": "SELECT NULL::BIGINT AS question_id, NULL AS facet_id", "ff": "SELECT NULL::BIGINT AS question_id, NULL AS form"}))
def temporal_mode(spark, folder):
    return _documents_as_questions(spark, folder).select("question_id", Q.temporal_mode("query").alias("temporal_mode"))


@query(O.sql("SELECT unit_id, state FROM u"))
def temporal_state(spark, folder):
    return _units(spark, folder).select("unit_id", "state")


@query(O.sql(f"SELECT unit_id, sha256({O._RENDER}) AS rendered, tokens FROM u JOIN cost USING (unit_id)"))
def render_unit(spark, folder):
    """Each unit as it stands in a context (as a digest), and its tokens."""
    return _units(spark, folder).select("unit_id", T.digest(T.render()).alias("rendered"), T.token_estimate(T.render()).cast("bigint").alias("tokens"))


@query(f"SELECT doc_id, {O.estimate('coalesce(text, $$$$)')} AS tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.token_estimate("text").cast("bigint").alias("tokens"))


@query(O.sql(f"""
SELECT relation_id, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 10) AS jaccard
FROM (SELECT relation_id, x.t AS a, y.t AS b FROM r JOIN ctok x ON x.unit_id = r.source_id JOIN ctok y ON y.unit_id = r.target_id)""",
    steps={"ctok": f"SELECT unit_id, list_distinct(list_transform(list_filter(regexp_extract_all(content, '{O._W}+'), lambda t: length(t) > 1), lambda t: {O.fold('t')})) AS t FROM u"}))
def jaccard_pairs(spark, folder):
    """Similarity of the contents at the ends of each relation."""
    c = corpus(spark, folder)
    t = c.units.select("unit_id", T.term_list("content").alias("t"))
    j = c.relations.join(t.select(F.col("unit_id").alias("source_id"), F.col("t").alias("a")), "source_id").join(t.select(F.col("unit_id").alias("target_id"), F.col("t").alias("b")), "target_id")
    return j.select("relation_id", r10(T.jaccard("a", "b")).alias("jaccard"))


@query(O.sql("SELECT unit_id, sha256(content) AS digest, sha256(content) = content_hash AS sound FROM u"))
def digest(spark, folder):
    return _units(spark, folder).select("unit_id", T.digest("content").alias("digest"), (T.digest("content") == F.col("content_hash")).alias("sound"))


@query("SELECT doc_id, sha256(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))) AS eol_hash FROM documents")
def eol_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.eol_digest("text").alias("eol_hash"))


# --- ingestion -----------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT * FROM sources WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, version DESC) = 1),
k AS (SELECT *, lag(content_hash) OVER w AS before, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY path ORDER BY created_at, version)),
v AS (SELECT path, content_hash, created_at, row_number() OVER (PARTITION BY path ORDER BY created_at, version) AS version FROM k WHERE n = 1 OR before IS DISTINCT FROM content_hash)
SELECT 'src:' || left(sha256(path), 16) || ':v' || version AS source_id, path, content_hash, version, version = max(version) OVER (PARTITION BY path) AS active FROM v""")
def source_versions(spark, folder):
    """The source deliveries as arrivals of files, versioned anew."""
    one = F.max(F.struct("created_at", "version", "path", "content_hash"))
    s = table(spark, folder, "sources").where("path is not null").groupBy("id").agg(one.alias("m")).select("m.path", "m.content_hash", "m.created_at", F.col("m.version").alias("given"))
    return ingest.source_versions(s, "created_at", "given").select("source_id", "path", "content_hash", F.col("version").cast("bigint").alias("version"), "active")


@query("""
WITH h AS (SELECT id, ingest_seq, sha256(coalesce(content, '')) AS content_hash FROM genes WHERE id IS NOT NULL),
n AS (SELECT *, lag(content_hash) OVER (PARTITION BY id ORDER BY ingest_seq) AS before FROM h)
SELECT id, max(ingest_seq) AS ingest_seq, arg_max(content_hash, ingest_seq) AS content_hash, count(*) AS writes FROM n WHERE before IS NULL OR before <> content_hash GROUP BY id""")
def unit_upsert(spark, folder):
    return ingest.unit_upsert(table(spark, folder, "genes"))


@query("SELECT locus_id, arg_min(coalesce(label, ''), ingest_seq) AS label FROM genes WHERE locus_id IS NOT NULL GROUP BY 1")
def subjects(spark, folder):
    return ingest.subjects(table(spark, folder, "genes").withColumn("label", F.coalesce("label", F.lit(""))))


@query("""
SELECT left(sha256(concat_ws(chr(31), coalesce(source_id, ''), coalesce(target_id, ''), coalesce(relation, ''), coalesce(evidence_json, ''))), 24) AS relation_id, min(ingest_seq) AS ingest_seq, arg_min(source_id, ingest_seq) AS source_id, arg_min(target_id, ingest_seq) AS target_id,
  count(*) AS arrivals FROM relations GROUP BY 1""")
def relation_dedupe(spark, folder):
    return ingest.relation_dedupe(table(spark, folder, "relations")).select("relation_id", "ingest_seq", "source_id", "target_id", "arrivals")


_H = f"(?m)^(#{{1,6}})[{O._SPACE}]+(.+?)[{O._SPACE}]*$"


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_H}') AS h, regexp_extract_all(text, '{_H}', 2) AS l, regexp_split_to_array(text, '{_H}') AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(b) AS body, unnest(list_concat([NULL], l)) AS label, unnest(list_concat([''], h)) AS head, generate_subscripts(b, 1) AS i FROM d),
n AS (SELECT doc_id, i, label, trim(body, '{O.BLANKS}') AS body, CASE WHEN i = 1 THEN 1 ELSE 1 + sum(length(head || body) - length(replace(head || body, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) - (length(head || body) - length(replace(head || body, chr(10), ''))) END AS line FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, coalesce(trim(label, '{O.BLANKS}'), 'doc-' || doc_id) AS label, CAST(line AS BIGINT) AS line, sha256(body) AS body_hash FROM n WHERE body <> ''""")
def sections(spark, folder):
    """Sections of every document."""
    s = ingest.sections(table(spark, folder, "documents"), "doc_id", "text", F.concat(F.lit("doc-"), "doc_id"))
    return s.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "label", F.col("line").cast("bigint").alias("line"), T.digest("body").alias("body_hash"))


@query(O.sql("""
SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY p) AS position, member AS source_id, target_id FROM (
  SELECT edge_id, p, member, lead(member) OVER (PARTITION BY edge_id ORDER BY p) AS target_id FROM (SELECT question_id AS edge_id, unnest(expected_gene_ids) AS member, generate_subscripts(expected_gene_ids, 1) AS p FROM q) SEMI JOIN u ON unit_id = member)
WHERE target_id IS NOT NULL"""))  # fmt: skip
def hyperedge_chain(spark, folder):
    """The expected units of each question as one hyperedge."""
    e = _questions(spark, folder).select(F.col("question_id").alias("edge_id"), F.col("expected_gene_ids").alias("members"))
    return ingest.hyperedge_chain(e, _units(spark, folder)).withColumn("position", F.col("position").cast("bigint"))


@query(f"""
SELECT DISTINCT path, list_has_any(string_split(lower(path), '/'), ['.git', '.evigrain', '.venv', 'node_modules']) OR string_split(lower(path), '/')[-1] IN {O._in(O.fixed.SENSITIVE_NAMES)}
    OR regexp_replace(string_split(lower(path), '/')[-1], '(.)\\.[^.]*$', '\\1') IN {O._in(O.fixed.SENSITIVE_STEMS)} AS sensitive,
  NOT sensitive AND regexp_extract(string_split(lower(path), '/')[-1], '.(\\.[^.]*)$', 1) IN {O._in(O.fixed.DOCUMENT_SUFFIXES)} AS readable FROM sources WHERE path IS NOT NULL""")
def sensitive_filter(spark, folder):
    s = table(spark, folder, "sources").where("path is not null").select("path").distinct()
    return s.select("path", ingest.sensitive("path").alias("sensitive"), ingest.readable("path").alias("readable"))


@query("""
SELECT 'genes' AS tbl, count(DISTINCT id) AS records FROM genes UNION ALL SELECT 'sources', count(DISTINCT id) FROM sources UNION ALL SELECT 'relations', count(DISTINCT id) FROM relations
UNION ALL SELECT 'loci', count(DISTINCT id) FROM loci UNION ALL SELECT 'events', count(*) FROM events""")
def status_counts(spark, folder):
    """Records of each table, a record delivered twice counted once."""
    out = None
    for t in ("genes", "sources", "relations", "loci", "events"):
        n = table(spark, folder, t).agg((F.count("*") if t == "events" else F.countDistinct("id")).alias("records")).select(F.lit(t).alias("tbl"), "records")
        out = n if out is None else out.unionByName(n)
    return out


_STATE = {
    "sources": ("id", "path", "content_hash", "version", "active"),
    "genes": ("id", "locus_id", "content", "kind", "active", "ingest_seq"),
    "relations": ("id", "source_id", "target_id", "relation", "ingest_seq"),
}


@query(" UNION ALL ".join(f"""
SELECT '{t}' AS tbl, count(*) AS rows, sha256(concat_ws(chr(31), count(*), {", ".join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)), 0)" for k in range(4))})) AS fingerprint
FROM (SELECT sha256(concat_ws(chr(31), {", ".join(f"coalesce(CAST({c} AS VARCHAR), '@0@')" for c in cs)})) AS h FROM {t})""" for t, cs in _STATE.items()).replace("'@0@'", "chr(0)"))  # fmt: skip
def state_fingerprint(spark, folder):
    out = None
    for t, cs in _STATE.items():
        n = audit.fingerprint(table(spark, folder, t), *cs).select(F.lit(t).alias("tbl"), "rows", "fingerprint")
        out = n if out is None else out.unionByName(n)
    return out


@query(O.sql("SELECT unit_id, subject_id, label, kind, sha256(content) AS content_hash, CASE WHEN summary = '' THEN left(content, 240) ELSE summary END AS summary FROM u WHERE content <> '' UNION ALL SELECT relation_id, source_id, target_id, relation, 'edge', '' FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL"))
def jsonl_scan(spark, folder):
    """Units and relations written as JSON lines and read back by the scanner."""
    c = corpus(spark, folder)
    u = c.units.where("content != ''").select(F.to_json(F.struct(F.col("unit_id").alias("id"), F.col("subject_id").alias("locus_id"), "label", "kind", "content", F.nullif("summary", F.lit("")).alias("summary"))).alias("value"))
    r = c.relations.select(F.to_json(F.struct(F.lit("relation").alias("record_type"), "source_id", "target_id", "relation", F.array("relation_id").alias("evidence"))).alias("value"))
    at = f"{shared_folder(spark)}/jsonl-{abs(hash(folder))}"
    u.unionByName(r).write.mode("overwrite").text(at)
    found, edges = ingest.read_records(spark, at, "corpus.jsonl")
    e = edges.select(F.get("evidence", F.lit(0)).alias("unit_id"), F.col("source_id").alias("subject_id"), F.col("target_id").alias("label"), F.col("relation").alias("kind"), F.lit("edge").alias("content_hash"), F.lit("").alias("summary"))
    return found.select("unit_id", "subject_id", "label", "kind", T.digest("content").alias("content_hash"), "summary").unionByName(e)


@query(O.sql("SELECT source_id, target_id, relation FROM r SEMI JOIN u ON u.unit_id = r.source_id WHERE target_id IN (SELECT unit_id FROM u)"))
def graph_json_scan(spark, folder):
    """The graph of units and relations written as exports, one per relation, and read back by the scanner."""
    c = corpus(spark, folder)
    ids = c.units.select(F.col("unit_id").alias("id"))
    r = c.relations.where("source_id is not null and target_id is not null")
    node = lambda end: F.struct(F.col(end).alias("id"))
    known = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
    r = r.join(known("source_id"), "source_id", "left").join(known("target_id"), "target_id", "left")
    nodes = F.filter(F.array(F.when(F.col("has_source_id"), node("source_id")), F.when(F.col("has_target_id"), node("target_id"))), lambda n: n.isNotNull())
    g = r.select(F.to_json(F.struct(nodes.alias("nodes"), F.array(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation").alias("type"))).alias("links"))).alias("value"))
    at = f"{shared_folder(spark)}/graph-{abs(hash(folder))}"
    g.write.mode("overwrite").text(at)
    _, edges = ingest.read_graph(spark, at, lines=True)
    name = ids.select("id", F.concat(F.lit(O.fixed.NODE_ID), F.substring(T.digest("id"), 1, 20)).alias("h"))
    e = edges.join(name.select(F.col("h").alias("source_id"), F.col("id").alias("s")), "source_id").join(name.select(F.col("h").alias("target_id"), F.col("id").alias("t")), "target_id")
    return e.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "relation")


# --- channels ------------------------------------------------------------------------------------------------------


def _rank(df):
    return df.withColumn("facet_id", F.col("facet_id").cast("bigint")).withColumn("rank", F.col("rank").cast("bigint"))


@query(O.sql("SELECT question_id, facet_id, unit_id, rank FROM c1"))
def substring_topk(spark, folder):
    return _rank(channels.substring(_facets(spark, folder), _units(spark, folder))).drop("score")


@query(O.sql("SELECT question_id, facet_id, unit_id, rank, score FROM c2"))
def bm25_topk(spark, folder):
    return _rank(channels.bm25(_facets(spark, folder), _units(spark, folder)))


@query(O.sql("SELECT question_id, facet_id, unit_id, rank, shared, score FROM c3"))
def overlap_topk(spark, folder):
    return _rank(channels.overlap(_facets(spark, folder), _units(spark, folder)))


@query(O.sql("SELECT question_id, unit_id FROM fb", steps={"fused0": "SELECT NULL::VARCHAR AS question_id LIMIT 0"}))
def fallback(spark, folder):
    """The fallback of every question, as if no channel had found anything."""
    p = _plan(spark, folder)
    nothing = p.select("question_id").where("false")
    return channels.fallback(p, nothing, _units(spark, folder)).select("question_id", "unit_id")


def _fused(spark, folder):
    return channels.fuse(channels.rankings(_facets(spark, folder), _units(spark, folder)))


@query(O.sql("SELECT question_id, unit_id, score, array_to_string(facets, ',') AS facets FROM fused0"))
def rrf(spark, folder):
    return _fused(spark, folder).select("question_id", "unit_id", "score", F.array_join("facets", ",").alias("facets"))


@query(O.sql("SELECT DISTINCT question_id, unit_id FROM pt"))
def protected_top2(spark, folder):
    return _fused(spark, folder).where("protected").select("question_id", "unit_id")


# --- graph and versions --------------------------------------------------------------------------------------------


def _start(spark, folder, c):
    p = materialise(_plan(spark, folder), "plan")
    runs = P.expand_methods(p, {"main": P.METHODS["main"]})
    fused = P.recall(p, c.units)
    return runs, fused.join(runs.select("question_id", "run_id"), "question_id").select("run_id", "unit_id", "score", "facets", "channels", "protected")


@query(O.sql("SELECT question_id, a AS anchor, b AS neighbour, relation, e.confidence FROM fused JOIN e ON a = unit_id"))
def frontier_join(spark, folder):
    """Edges, from either end, that begin at a candidate."""
    c = corpus(spark, folder)
    _, start = _start(spark, folder, c)
    near = start.select(F.col("run_id").alias("question_id"), F.col("unit_id").alias("anchor")).join(expansion.both_ways(c.relations), "anchor")
    return near.select("question_id", "anchor", "neighbour", "relation", "confidence")


def _hops(spark, folder, hops):
    c = corpus(spark, folder)
    _, start = _start(spark, folder, c)
    return expansion.expand(start, c.relations, c.units, hops)


@query(O.sql("SELECT question_id, unit_id, score, CAST(depth AS INT) AS depth, array_to_string(channels, ' ') AS channels FROM h1"))
def expand_h1(spark, folder):
    mine = F.filter("channels", lambda x: F.startswith(x, F.lit("graph:")))
    return _hops(spark, folder, 1).select(F.col("run_id").alias("question_id"), "unit_id", "score", "depth", _joined(mine).alias("channels"))


@query(O.sql("SELECT question_id, unit_id, score, CAST(depth AS INT) AS depth FROM h2"))
def expand_h2(spark, folder):
    return _hops(spark, folder, 2).select(F.col("run_id").alias("question_id"), "unit_id", "score", "depth")


@query(O.sql("SELECT question_id, unit_id, array_to_string(facets, ',') AS facets FROM h2"))
def facet_inherit(spark, folder):
    return _hops(spark, folder, 2).select(F.col("run_id").alias("question_id"), "unit_id", F.array_join("facets", ",").alias("facets"))


def _candidates(spark, folder):
    c = corpus(spark, folder)
    p = materialise(_plan(spark, folder), "plan")
    runs = P.expand_methods(p, {"main": P.METHODS["main"]})
    return c, runs, materialise(P.spread(P.recall(p, c.units), runs, c), "candidates")


@query(O.sql("SELECT question_id, unit_id, score, array_to_string(facets, ',') AS facets, protected FROM cand"))
def current_version(spark, folder):
    """Candidates with the current versions of superseded ones."""
    _, _, out = _candidates(spark, folder)
    return out.select(F.col("run_id").alias("question_id"), "unit_id", "score", F.array_join("facets", ",").alias("facets"), "protected")


@query(O.sql("SELECT question_id, unit_id, u.subject_id, EXISTS (FROM u n WHERE n.subject_id = u.subject_id AND n.active AND n.state = 'current') AS replaced FROM cand JOIN u USING (unit_id) JOIN qx USING (question_id) WHERE mode = 'current' AND state = 'historical'"))
def superseded(spark, folder):
    c, runs, out = _candidates(spark, folder)
    return temporal.superseded(out.join(runs.select("run_id", "temporal_mode"), "run_id"), c.units).select(F.col("run_id").alias("question_id"), "unit_id", "subject_id", "replaced")


@query(O.sql("SELECT unit_id, CASE WHEN s.active THEN 1.03::DOUBLE WHEN s.source_id IS NOT NULL THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM u LEFT JOIN s USING (source_id)"))
def source_recency(spark, folder):
    c = corpus(spark, folder)
    s = c.sources.select("source_id", F.col("active").alias("on"))
    return c.units.join(s, "source_id", "left").select("unit_id", F.when(F.col("on"), O.fixed.SOURCE_CURRENT).when(F.col("on").isNotNull(), O.fixed.SOURCE_OLD).otherwise(1.0).alias("factor"))


@query(O.sql("SELECT relation_id, field, missing_id FROM (SELECT relation_id, 'source_id' AS field, source_id AS missing_id FROM r UNION ALL SELECT relation_id, 'target_id', target_id FROM r) WHERE missing_id IS NULL OR missing_id NOT IN (SELECT unit_id FROM u WHERE active)"))
def dangling_edges(spark, folder):
    c = corpus(spark, folder)
    return expansion.dangling(c.relations, c.units)


# --- scoring and packing -------------------------------------------------------------------------------------------


def _regulated(spark, folder):
    c, runs, out = _candidates(spark, folder)
    return c, scoring.regulate(out, runs, c.units, c.sources, c.marks)


def _scored(spark, folder):
    c, r = _regulated(spark, folder)
    return c, materialise(scoring.threshold(materialise(r, "regulated")), "scored")


@query(O.sql("SELECT question_id, unit_id, score, array_to_string(matched, ' ') AS matched FROM scored WHERE excluded IS NULL"))
def confidence_coverage(spark, folder):
    """The score of each candidate that isn't excluded, after all modifiers."""
    return _regulated(spark, folder)[1].where("excluded is null").select("question_id", "unit_id", "score", _joined("matched").alias("matched"))


@query(O.sql(f"SELECT question_id, unit_id, {' OR '.join(f'task = {t!r} AND {O.fold(chr(107) + chr(105) + chr(110) + chr(100))} IN {O._in(k)}' for t, k in O.fixed.TASK_KINDS.items())} AS boosted FROM scored JOIN u USING (unit_id) JOIN qx USING (question_id) WHERE excluded IS NULL"))
def task_boost(spark, folder):
    """Whether the kind of each remaining candidate suits the task of the question."""
    r = _regulated(spark, folder)[1].where("excluded is null")
    return r.select("question_id", "unit_id", F.col("fits").alias("boosted"))


@query(O.sql("SELECT unit_id, boost, 1 + boost AS factor FROM mk"))
def feedback_boost(spark, folder):
    return corpus(spark, folder).marks.select("unit_id", "boost", (1 + F.col("boost")).alias("factor"))


@query(O.sql("SELECT question_id, unit_id, array_to_string(barred, ' ') AS matched FROM scored WHERE excluded = 'repressor matched'", steps={
    "q": "SELECT question_id, category, coalesce(query, '') || ' -' || kind_ AS query, coalesce(budget, 1200) AS budget, expected_gene_ids FROM questions, (SELECT 'checkpoint' AS kind_)"}))
def suppressor_terms(spark, folder):
    """Candidates that a term asked away excludes; every question is given one."""
    c = corpus(spark, folder)
    p = materialise(P.planned(_questions(spark, folder).withColumn("query", F.concat(F.coalesce("query", F.lit("")), F.lit(" -checkpoint")))), "plan")
    runs = P.expand_methods(p, {"main": P.METHODS["main"]})
    out = materialise(P.spread(P.recall(p, c.units), runs, c), "candidates")
    r = scoring.regulate(out, runs, c.units, c.sources, c.marks)
    return r.where("excluded = 'repressor matched'").select("question_id", "unit_id", _joined("barred").alias("matched"))


@query(O.sql("SELECT question_id, unit_id, array_to_string(core, ',') AS core_facets FROM scored WHERE len(core) > 0"))
def core_match(spark, folder):
    return _regulated(spark, folder)[1].where(F.size("core_facets") > 0).select("question_id", "unit_id", F.array_join("core_facets", ",").alias("core_facets"))


@query(O.sql("SELECT question_id, unit_id, score, floor, excluded FROM th"))
def threshold(spark, folder):
    """Every candidate with its score, the floor of its run and why it is excluded."""
    return _scored(spark, folder)[1].select("question_id", "unit_id", "score", "floor", "excluded")


@query(O.sql("SELECT question_id, term, weight FROM tw"))
def term_weights(spark, folder):
    c, runs, out = _candidates(spark, folder)
    scored = materialise(scoring.threshold(materialise(scoring.regulate(out, runs, c.units, c.sources, c.marks), "regulated")), "scored")
    return scoring.term_weights(scored, runs).select(F.col("run_id").alias("question_id"), "term", "weight")


_ORDERED = {"ordered": "SELECT question_id, unit_id, tokens, budget, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, tokens, unit_id) AS at FROM scored WHERE excluded IS NULL AND tokens <= budget"}


@query(O.sql("SELECT question_id, unit_id, CAST(rank AS INT) AS rank FROM packed", O.IN_ORDER, _ORDERED))
def pack_score_order(spark, folder):
    """Packing of all candidates that aren't excluded in the order of their score."""
    r = _regulated(spark, folder)[1].where("excluded is null")
    out = packing.pack_in_order(r, (-F.col("score")).alias("s"), F.col("tokens").alias("t"), F.col("unit_id").alias("u"))
    return out.select(F.col("run_id").alias("question_id"), "unit_id", "rank")


def _retrieved(spark, folder):
    return P.retrieve(_questions(spark, folder), corpus(spark, folder))


@query(O.sql("SELECT question_id, unit_id, CAST(rank AS INT) AS rank, round(utility, 8) AS utility FROM packed", O.COVERAGE))
def pack_coverage(spark, folder):
    c, scored = _scored(spark, folder)
    return packing.pack_by_coverage(scored, c.units).where("rank is not null").select(F.col("run_id").alias("question_id"), "unit_id", "rank", F.round("utility", 8).alias("utility"))


@query(O.sql(f"SELECT question_id, sha256(string_agg({O._RENDER}, chr(10) || chr(10) ORDER BY rank)) AS context, CAST(sum(tokens) AS BIGINT) AS context_tokens, count(*) AS selected FROM packed JOIN u USING (unit_id) JOIN cost USING (unit_id) GROUP BY question_id", O.COVERAGE))
def context_assembly(spark, folder):
    """The context of each question as a digest, its tokens and its units."""
    r = _retrieved(spark, folder)
    return r.contexts().select(F.col("run_id").alias("question_id"), T.digest("context").alias("context"), "context_tokens", F.size("selected").cast("bigint").alias("selected"))


@query(O.sql("""
SELECT q.question_id, CAST(any_value(q.budget) AS BIGINT) AS budget, any_value(qx.facet_count) AS facet_count, count(th.unit_id) AS candidate_count, count(*) FILTER (th.unit_id IS NOT NULL AND excluded IS NULL) AS expressed_count, CAST(coalesce(sum(th.tokens) FILTER (rank IS NOT NULL), 0) AS BIGINT) AS context_tokens,
  count(rank) AS selected_count, CAST(coalesce(len(list_distinct(flatten(list(th.facets) FILTER (rank IS NOT NULL)))), 0) AS BIGINT) AS covered_facets, count(th.unit_id) - count(rank) AS excluded_count, round(coalesce(sum(th.tokens) FILTER (rank IS NOT NULL), 0) / any_value(q.budget), 10) AS budget_utilization
FROM q JOIN qx USING (question_id) LEFT JOIN th USING (question_id) LEFT JOIN packed USING (question_id, unit_id) GROUP BY q.question_id""", O.COVERAGE))  # fmt: skip
def run_metrics(spark, folder):
    return _retrieved(spark, folder).metrics().drop("run_id")


@query()
def retrieve(spark, folder):
    """The flagship: the selected units of every question with citation and reasons, in order."""
    return _retrieved(spark, folder).selected().drop("run_id", "source_known")


@query()
def explain(spark, folder):
    """Every excluded candidate of every question with the reason."""
    return _retrieved(spark, folder).excluded().drop("run_id")


# --- audit ---------------------------------------------------------------------------------------------------------


def _events(spark, folder):
    return audit_events(table(spark, folder, "events"), _units(spark, folder))


@query(O.sql("SELECT * FROM mk"))
def marks_replay(spark, folder):
    return audit.marks(_events(spark, folder))


_AS_OF = 5000


@query(O.sql("SELECT * FROM mk", steps={"ev": O.STEPS["ev"] + f" WHERE event_id <= {_AS_OF}"}))
def marks_asof(spark, folder):
    """Marks as they were at one event."""
    return audit.marks_as_of(_events(spark, folder), f"evt:{_AS_OF}")


@query(O.sql("SELECT unit_id, suppressed FROM mk"))
def suppress_state(spark, folder):
    return audit.marks(_events(spark, folder)).select("unit_id", "suppressed")


_BODY = "concat_ws(chr(31), event_id, event_type, coalesce(unit_id, ''), '', coalesce(CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), ''), '', '', CAST(epoch_us(created_at) AS VARCHAR), '')"
_LINKED = f"""
, b AS MATERIALIZED (SELECT event_id, {_BODY} AS body, row_number() OVER (ORDER BY seq) AS n FROM ev),
chain AS (SELECT n, event_id, 'GENESIS' AS prev_hash, sha256(body || 'GENESIS') AS event_hash FROM b WHERE n = 1
  UNION ALL SELECT b.n, b.event_id, c.event_hash, sha256(b.body || c.event_hash) FROM chain c JOIN b ON b.n = c.n + 1)"""


@query(O.sql("SELECT event_id, prev_hash, event_hash FROM chain", _LINKED))
def chain_append(spark, folder):
    """The event table linked from the beginning."""
    return audit.link(_events(spark, folder)).select("event_id", "prev_hash", "event_hash")


@query(O.sql("SELECT NULL::VARCHAR AS subject, NULL::VARCHAR AS record_id, NULL::VARCHAR AS error LIMIT 0"))
def chain_verify(spark, folder):
    """Breaks of the linked log and of the unit texts: none."""
    log = materialise(audit.link(_events(spark, folder)), "log")
    u = _units(spark, folder).withColumn("content_hash", T.digest("content"))
    return audit.verify(log, u)


@query(O.sql("""
SELECT 'event' AS subject, event_id AS record_id, 'content hash mismatch' AS error FROM ev WHERE seq % 1000 = 7 UNION ALL
SELECT 'event', event_id, 'previous hash mismatch' FROM ev WHERE seq % 1000 = 502 UNION ALL SELECT 'event', event_id, 'content hash mismatch' FROM ev WHERE seq % 1000 = 502"""))  # fmt: skip
def tamper_report(spark, folder):
    """What verification tells of a log some of whose events were altered and some relinked."""
    log = materialise(audit.link(_events(spark, folder)), "log")
    bent = log.withColumn("value", F.when(F.col("seq") % 1000 == 7, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value"))).withColumn("prev_hash", F.when(F.col("seq") % 1000 == 502, "broken").otherwise(F.col("prev_hash")))
    return audit.verify(bent)


@query(O.sql("SELECT 'evt:' || left(sha256(concat_ws(chr(31), 'feedback.accepted', question_id, unit_id)), 32) AS event_id, unit_id, question_id AS run_id, 1.0::DOUBLE AS value FROM packed", O.COVERAGE))
def feedback_events(spark, folder):
    """Acceptance of everything that was selected."""
    s = _retrieved(spark, folder).selected()
    return audit.feedback(s, True).select("event_id", "unit_id", "run_id", "value")


# --- evaluation ----------------------------------------------------------------------------------------------------


def _rows(spark, folder, methods):
    """Metrics of the given pipeline methods and of the two baselines without a pipeline, for each question."""
    c, q = held(corpus(spark, folder)), _questions(spark, folder)

    mine, rag = together(spark, lambda: materialise(P.select(q, c, methods), "selected"), lambda: materialise(evaluate.local_rag(q, c.units), "local-rag"))
    rag = rag.select(F.col("run_id").alias("question_id"), "unit_id", "rank")
    cited = evaluate.citable(c.units.join(rag.select("unit_id").distinct(), "unit_id", "left_semi"), c.sources)
    mine = mine.unionByName(rag.join(cited, "unit_id").select("question_id", F.lit("local_rag").alias("method"), "unit_id", "rank", "valid"))
    # all methods at once: a selection is one of a question and a method, and units are read once
    key = F.concat_ws("|", "question_id", "method").alias("question_id")
    picked = materialise(mine.select(key, "unit_id", "rank", "valid"), "picked")
    asked = q.select("question_id", "expected_gene_ids", F.explode(F.array(*map(F.lit, [*methods, "local_rag"]))).alias("method"))
    rows = evaluate.selected_metrics(asked.select(key, "expected_gene_ids"), picked.drop("valid"), c.units, picked.drop("rank"), F.lit(""))
    names = asked.select(key.alias("key"), F.col("question_id").alias("id"), F.col("method").alias("by"))
    rows = rows.join(names, rows.question_id == names.key).select(F.col("id").alias("question_id"), F.col("by").alias("method"), *rows.columns[2:])
    out = rows.unionByName(evaluate.full_context(q, c.units, c.sources))
    return materialise(out.join(q.select("question_id", "category"), "question_id"), "metrics")


_MAIN = {"main": P.METHODS["main"]}

_EVAL = {
    "rt": f"SELECT unit_id, tokens, length({O._RENDER}) AS chars, strlen({O._RENDER}) AS bytes, coalesce(length(s.content_hash) = 64 AND s.version >= 1 AND source_location <> '', false) AS valid, s.source_id IS NOT NULL AND source_location <> '' AS cited, u.active FROM u JOIN cost USING (unit_id) LEFT JOIN s USING (source_id)",
    "xp": "SELECT DISTINCT question_id, unit_id FROM (SELECT question_id, unnest(expected_gene_ids) AS unit_id FROM q) WHERE unit_id <> ''",
    "fullrank": "SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS rank FROM u WHERE active",
    "ragscore": f"""SELECT question_id, unit_id, tokens, b AS budget, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS at FROM (
  SELECT question_id, unit_id, any_value(tokens) AS tokens, any_value(b) AS b, round(count(*) / (any_value(n) + any_value(m) - count(*)), 10) AS score FROM qt JOIN ut USING (t) JOIN u USING (unit_id) JOIN cost USING (unit_id) JOIN (SELECT unit_id, count(*) AS n FROM ut GROUP BY 1) USING (unit_id) JOIN (SELECT question_id, count(*) AS m FROM qt GROUP BY 1) USING (question_id)
  JOIN (SELECT question_id, coalesce(budget, 600) AS b FROM questions) USING (question_id) WHERE active GROUP BY ALL) WHERE tokens <= b""",
}

_METRIC_ROWS = """
, rag AS (
  SELECT question_id, 0::BIGINT AS at, 0::BIGINT AS used, 0 AS rank, NULL::VARCHAR AS unit_id FROM (SELECT DISTINCT question_id FROM ragscore)
  UNION ALL
  SELECT w.question_id, o.at, w.used + o.tokens, w.rank + 1, o.unit_id FROM rag w JOIN LATERAL (SELECT x.at, x.tokens, x.unit_id FROM ragscore x WHERE x.question_id = w.question_id AND x.at > w.at AND w.used + x.tokens <= x.budget ORDER BY x.at LIMIT 1) o ON true
), picked AS MATERIALIZED (
  SELECT 'main' AS method, question_id, unit_id, rank, cited AS ok FROM packed JOIN rt USING (unit_id) UNION ALL SELECT 'local_rag', question_id, unit_id, rank, valid FROM rag JOIN rt USING (unit_id) WHERE rank > 0
  UNION ALL SELECT 'full_context', question_id, unit_id, rank, valid FROM q, fullrank JOIN rt USING (unit_id)
), totals AS MATERIALIZED (
  SELECT m.method, q.question_id, category, count(rank) AS selected, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS context_tokens, CAST(coalesce(sum(chars) + 2 * (count(rank) - 1), 0) AS BIGINT) AS context_chars, CAST(coalesce(sum(bytes) + 2 * (count(rank) - 1), 0) AS BIGINT) AS context_bytes, count(*) FILTER (ok) AS cites,
    count(xp.unit_id) AS hits, min(rank) FILTER (xp.unit_id IS NOT NULL) AS first, coalesce(sum(1.0 / log2(rank + 1)) FILTER (xp.unit_id IS NOT NULL), 0) AS dcg
  FROM q CROSS JOIN (SELECT unnest(['main', 'local_rag', 'full_context']) AS method) m LEFT JOIN picked p ON p.question_id = q.question_id AND p.method = m.method LEFT JOIN rt ON rt.unit_id = p.unit_id LEFT JOIN xp ON xp.question_id = q.question_id AND xp.unit_id = p.unit_id GROUP BY ALL
), base AS (
  SELECT *, (SELECT count(*) FROM xp WHERE xp.question_id = totals.question_id) AS wanted FROM totals
), rp AS (
  SELECT *, CASE WHEN wanted = 0 THEN 1 ELSE hits / wanted END AS rec, CASE WHEN selected > 0 THEN hits / selected WHEN wanted = 0 THEN 1 ELSE 0 END AS prec,
    coalesce(list_sum(list_transform(range(1, 1 + least(wanted, selected)), lambda k: 1.0 / log2(k + 1))), 0) AS ideal FROM base
), rows AS MATERIALIZED (
  SELECT question_id, method, category, round(rec, 10)::DOUBLE AS recall, round(prec, 10)::DOUBLE AS precision, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 10)::DOUBLE AS f1, round(coalesce(1.0 / first, 0), 10)::DOUBLE AS mrr,
    round(CASE WHEN ideal > 0 THEN dcg / ideal WHEN wanted = 0 THEN 1 ELSE 0 END, 10)::DOUBLE AS ndcg, round(CASE WHEN selected > 0 THEN cites / selected ELSE 1 END, 10)::DOUBLE AS citation_accuracy, context_tokens, context_chars, context_bytes, selected FROM rp
)"""  # fmt: skip


def _esql(select):
    return O.sql(select, O.COVERAGE + _METRIC_ROWS, _EVAL)


@query(_esql("SELECT question_id, method, recall, precision, f1 FROM rows"))
def metrics_prf(spark, folder):
    return _rows(spark, folder, _MAIN).select("question_id", "method", "recall", "precision", "f1")


@query(_esql("SELECT question_id, method, mrr FROM rows"))
def mrr(spark, folder):
    return _rows(spark, folder, _MAIN).select("question_id", "method", "mrr")


@query(_esql("SELECT question_id, method, ndcg FROM rows"))
def ndcg(spark, folder):
    return _rows(spark, folder, _MAIN).select("question_id", "method", "ndcg")


@query(_esql("SELECT question_id, context_tokens, context_chars, context_bytes, selected FROM rows WHERE method = 'full_context'"))
def full_context(spark, folder):
    c = corpus(spark, folder)
    return evaluate.full_context(_questions(spark, folder), c.units, c.sources).select("question_id", "context_tokens", "context_chars", "context_bytes", "selected")


@query(O.sql("SELECT question_id, unit_id, CAST(rank AS INT) AS rank FROM packed", O.IN_ORDER.replace("ordered", "ragscore"), _EVAL))
def local_rag(spark, folder):
    return evaluate.local_rag(_questions(spark, folder), corpus(spark, folder).units).select(F.col("run_id").alias("question_id"), "unit_id", "rank")


@query(O.sql("SELECT unit_id, valid FROM rt", steps=_EVAL))
def citation_validity(spark, folder):
    c = corpus(spark, folder)
    return evaluate.citable(c.units, c.sources)


_MEANS = ", ".join(f"round(avg({m}), 10) AS {m}" for m in evaluate.METRICS)
_SUMMARY = f"SELECT category, method, CAST(grouping(category) AS INT) AS overall, count(*) AS questions, {_MEANS} FROM rows GROUP BY GROUPING SETS ((method), (category, method))"


@query(_esql(_SUMMARY))
def summary_grouping_sets(spark, folder):
    return evaluate.summarize(_rows(spark, folder, _MAIN)).withColumn("overall", F.col("overall").cast("int"))


_BASELINES = ["full_context", "local_rag"]
_COMPARATOR = "(SELECT method FROM (SELECT method, round(avg(recall), 10) AS r, round(avg(context_tokens), 10) AS t FROM rows WHERE method <> 'main' GROUP BY 1) ORDER BY r DESC, t, method LIMIT 1)"
_PAIRED = f"SELECT question_id, a.category, round(a.recall - b.recall, 10) AS quality_delta, b.context_tokens - a.context_tokens AS tokens_saved FROM rows a JOIN rows b USING (question_id) WHERE a.method = 'main' AND b.method = {_COMPARATOR}"


@query(_esql(_PAIRED))
def paired_deltas(spark, folder):
    rows = _rows(spark, folder, _MAIN)
    return evaluate.paired(rows, evaluate.comparator(evaluate.summarize(rows), _BASELINES))


@query(_esql(f"""
SELECT comparator, token_savings, quality_delta, worst_category_delta, citation_accuracy, stability, token_savings >= 0.25 AS gate_tokens, quality_delta >= -0.02 AS gate_quality, citation_accuracy >= 0.95 AS gate_citations, worst_category_delta >= -0.1 AS gate_category, stability >= 1 AS gate_stability,
  CASE WHEN NOT (gate_tokens AND gate_quality AND gate_citations AND gate_category AND gate_stability) THEN 'FAIL' WHEN n < 30 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS outcome FROM (
  SELECT {_COMPARATOR} AS comparator, 1.0::DOUBLE AS stability, (SELECT count(*) FROM q) AS n, (SELECT round(avg(citation_accuracy), 10) FROM rows WHERE method = 'main') AS citation_accuracy,
    (SELECT round(1 - m.t / b.t, 10) FROM (SELECT round(avg(context_tokens), 10) AS t FROM rows WHERE method = 'main') m, (SELECT round(avg(context_tokens), 10) AS t FROM rows WHERE method = {_COMPARATOR}) b) AS token_savings,
    (SELECT round(m.t - b.t, 10) FROM (SELECT round(avg(recall), 10) AS t FROM rows WHERE method = 'main') m, (SELECT round(avg(recall), 10) AS t FROM rows WHERE method = {_COMPARATOR}) b) AS quality_delta,
    (SELECT round(min(a.t - b.t), 10) FROM (SELECT category, round(avg(recall), 10) AS t FROM rows WHERE method = 'main' GROUP BY 1) a JOIN (SELECT category, round(avg(recall), 10) AS t FROM rows WHERE method = {_COMPARATOR} GROUP BY 1) b USING (category)) AS worst_category_delta)"""))  # fmt: skip
def comparator_gate(spark, folder):
    s = materialise(evaluate.summarize(_rows(spark, folder, _MAIN)), "summary")
    return evaluate.gates(s, evaluate.comparator(s, _BASELINES))


@query(_esql(f"""
SELECT round(avg(m), 6) AS mean, any_value(low) AS ci95_low, any_value(high) AS ci95_high, 10000::BIGINT AS rounds FROM (SELECT tokens_saved AS m FROM ({_PAIRED})), (
  SELECT list_sort(list(m))[251] AS low, list_sort(list(m))[9751] AS high FROM (
    SELECT i, round(sum(v) / any_value(n), 6) AS m FROM (SELECT i, j, CAST('0x' || left(md5('20260718|' || i || '|' || j), 8) AS BIGINT) % n AS k, n FROM range(10000) a(i), (SELECT count(*) AS n FROM ({_PAIRED})) c, LATERAL (SELECT unnest(range(n)) AS j) d)
    JOIN (SELECT row_number() OVER (ORDER BY question_id) - 1 AS k, CAST(tokens_saved AS DOUBLE) AS v FROM ({_PAIRED})) USING (k) GROUP BY i))"""))  # fmt: skip
def bootstrap(spark, folder):
    rows = _rows(spark, folder, _MAIN)
    return evaluate.bootstrap(evaluate.paired(rows, evaluate.comparator(evaluate.summarize(rows), _BASELINES)), "tokens_saved")


@query("SELECT question_id AS run_id, 1::BIGINT AS unique_signatures, 3::BIGINT AS repetitions, true AS stable FROM questions")
def stability(spark, folder):
    """Three retrievals of every question, one with its input in another order and other partitions."""
    q, c = _questions(spark, folder), held(corpus(spark, folder))
    turned = q.orderBy(F.desc("question_id")).repartition(5)
    reps = together(spark, *[lambda x=x: materialise(evaluate.signatures(P.retrieve(x, c).contexts()), "signatures") for x in (q, q, turned)])
    out = evaluate.stability(reps)
    # a question that selects nothing has no context, three times
    none = q.select(F.col("question_id").alias("run_id")).join(out, "run_id", "left_anti")
    return out.unionByName(none.select("run_id", F.lit(1).cast("bigint").alias("unique_signatures"), F.lit(3).cast("bigint").alias("repetitions"), F.lit(True).alias("stable")))


@query()
def ablations(spark, folder):
    """Metrics of all eight methods for every question."""
    return _rows(spark, folder, P.METHODS)


@query()
def evaluation_report(spark, folder):
    """All eight methods: comparator among the three baselines, gates and outcome."""
    s = materialise(evaluate.summarize(_rows(spark, folder, P.METHODS)), "summary")
    return evaluate.gates(s, evaluate.comparator(s, [*_BASELINES, "graph_baseline"]))


@query()
def report_diff(spark, folder):
    """What changes in the outcome when packing goes by score alone."""
    s = materialise(evaluate.summarize(_rows(spark, folder, {m: P.METHODS[m] for m in ("main", "ablation_no_packing")})), "summary")
    base = evaluate.comparator(s, _BASELINES)
    return evaluate.report_diff(evaluate.gates(s, base), evaluate.gates(s, base, method="ablation_no_packing"))


@query(O.sql("""
SELECT 'empty id or query' AS error, question_id, '' AS detail FROM questions WHERE coalesce(question_id, '') = '' OR coalesce(query, '') = '' UNION ALL
SELECT 'repeated id', question_id, CAST(count(*) AS VARCHAR) FROM questions GROUP BY question_id HAVING count(*) > 1 UNION ALL SELECT 'repeated query', min(question_id), CAST(count(*) AS VARCHAR) FROM questions GROUP BY query HAVING count(*) > 1 UNION ALL
SELECT 'nothing expected', question_id, '' FROM q WHERE question_id NOT IN (SELECT question_id FROM xp) UNION ALL SELECT 'unknown unit', question_id, unit_id FROM xp WHERE unit_id NOT IN (SELECT unit_id FROM u WHERE active)""", steps=_EVAL))  # fmt: skip
def suite_validation(spark, folder):
    return evaluate.suite_errors(_questions(spark, folder), _units(spark, folder))


__all__ = ["NOW", "ORACLE", "QUERIES"]
