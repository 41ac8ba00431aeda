"""Ingestion: guards, scans of documents, JSON lines and graph exports, and upserts of sources, units and relations.

Scans return frames of the store's columns; nothing is collected. A batch of arrivals is versioned by windows over its
own keys, so a path or an id with many arrivals is a long group of narrow rows, never of texts.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.text import SPACE, col, digest
from evigrain.sources.tables import BLANKS

#: A heading of one to six marks; the space behind them may run over line ends, so a bare mark takes the next line for its label.
_HEADING = f"(?md)^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*$"

UNIT = (
    "record_type string, id string, locus_id string, label string, kind string, content string, summary string, source string, source_location string, community string, "
    "confidence double, valid_from string, valid_to string, metadata string, source_id string, target_id string, relation string, evidence array<string>"
)
GRAPH = (
    "version string, nodes array<struct<id:string,name:string,label:string,content:string,description:string,summary:string,type:string,kind:string,source_location:string,source_file:string,community:string,community_id:string,locus:string,confidence:double>>, "
    "links array<struct<source:string,target:string,type:string,relation:string,confidence:double,evidence:array<string>,directed:boolean>>, edges array<struct<source:string,target:string,type:string,relation:string,confidence:double,evidence:array<string>,directed:boolean>>, "
    "hyperedges array<struct<id:string,members:array<string>,type:string,confidence:double>>"
)


def inside(root: str, path: str) -> str:
    """``path`` below ``root``, resolved; one that leads out of it is an error."""

    def resolve(p: str) -> PurePosixPath:
        out: list[str] = []
        for part in PurePosixPath(p).parts:
            if part == "..":
                out[1:] = out[1:-1]
            elif part != ".":
                out.append(part)
        return PurePosixPath(*out)

    base = resolve(root)
    full = resolve(path if path.startswith("/") else f"{root}/{path}")
    if full != base and base not in full.parents:
        raise ValueError(f"path leads out of the root: {path}")
    return str(full)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """A file name without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def sensitive(path: Column | str) -> Column:
    """A name, a stem or a folder that secrets are kept under, in any case."""
    low = F.lower(col(path))
    return file_name(low).isin(fixed.SENSITIVE_NAMES) | stem(low).isin(fixed.SENSITIVE_STEMS) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, fixed.SENSITIVE_PARTS)))


def readable(path: Column | str) -> Column:
    """A document by its suffix that isn't sensitive."""
    suffix = F.regexp_extract(F.lower(file_name(path)), "(?<=.)(\\.[^.]*)$", 1)
    return suffix.isin(fixed.DOCUMENT_SUFFIXES) & ~sensitive(path)


def sections(docs: DataFrame, key: str, text: str, name: Column) -> DataFrame:
    """(key, ordinal, label, line, body): what stands under each heading, and before the first one under ``name``.

    Bodies are trimmed and empty ones dropped; ordinals count what is left. A text without headings is one section; null and
    blank texts have none. Headings inside code count as well.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    heads, labels, bodies = F.regexp_extract_all(t, F.lit(_HEADING), F.lit(0)), F.regexp_extract_all(t, F.lit(_HEADING), F.lit(2)), F.split(t, _HEADING)
    d = docs.select(F.col(key), name.alias("_name"), heads.alias("_h"), labels.alias("_l"), bodies.alias("_b"))
    rows = F.transform(
        "_b",
        lambda b, i: F.struct(
            F.trim(b, F.lit(BLANKS)).alias("body"),
            F.when(i > 0, F.trim(F.get("_l", i - 1), F.lit(BLANKS))).alias("label"),
            # line ends in all that stands before the heading
            F.when(i > 0, 1 + _line_ends(F.concat(F.array_join(F.slice("_b", F.lit(1), i), ""), F.array_join(F.slice("_h", F.lit(1), i - 1), "")))).otherwise(1).alias("line"),
        ),
    )
    kept = F.filter(rows, lambda r: r.body != "")
    return d.select(F.col(key), "_name", F.posexplode(kept).alias("p", "r")).select(key, (F.col("p") + 1).alias("ordinal"), F.coalesce("r.label", "_name").alias("label"), F.col("r.line").alias("line"), F.col("r.body").alias("body"))


def _line_ends(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def source_versions(arrivals: DataFrame, *order: str) -> DataFrame:
    """Versions of each path from arrivals (path, content_hash, ...): (source_id, path, content_hash, version, active) and the order.

    An arrival that equals the one before it is none; going back to an older text is a new version. The last one is active.
    Null paths are dropped.
    """
    by = Window.partitionBy("path")
    w = by.orderBy(*order)
    kept = arrivals.where("path is not null").withColumn("_before", F.lag("content_hash").over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("content_hash").eqNullSafe(F.col("_before")))
    v = kept.withColumn("version", F.row_number().over(w)).withColumn("_last", F.max("version").over(by))
    name = F.concat(F.lit("src:"), F.substring(digest("path"), 1, 16), F.lit(":v"), F.col("version"))
    return v.select(name.alias("source_id"), "path", "content_hash", "version", (F.col("version") == F.col("_last")).alias("active"), *order)


def unit_upsert(arrivals: DataFrame, key: str = "id", seq: str = "ingest_seq") -> DataFrame:
    """(key, seq, content_hash, writes): the arrival of each unit that the store holds in the end, and how often it was written.

    An arrival whose content equals what is held changes nothing, not even other columns.
    """
    w = Window.partitionBy(key).orderBy(seq)
    h = arrivals.where(F.col(key).isNotNull()).select(key, seq, digest("content").alias("content_hash"))
    new = h.withColumn("_b", F.lag("content_hash").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("content_hash")))
    return new.groupBy(key).agg(F.max(seq).alias(seq), F.max_by("content_hash", seq).alias("content_hash"), F.count("*").alias("writes"))


def subjects(arrivals: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """(locus_id, label): the first label of each subject wins."""
    return arrivals.where("locus_id is not null").groupBy("locus_id").agg(F.min_by("label", seq).alias("label"))


def relation_id(source: str = "source_id", target: str = "target_id", relation: str = "relation", evidence: str = "evidence_json") -> Column:
    """Identity of an edge: its ends, name and evidence, not its confidence or metadata."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (source, target, relation, evidence)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def relation_dedupe(arrivals: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The first arrival of each edge; later ones are ignored. Narrow: aggregated on the map side."""
    r = arrivals.select(relation_id().alias("relation_id"), seq, "source_id", "target_id", "relation", "confidence")
    return r.groupBy("relation_id").agg(F.min(F.struct(seq, "source_id", "target_id", "relation", "confidence")).alias("m"), F.count("*").alias("arrivals")).select("relation_id", "m.*", "arrivals")


def hyperedge_chain(edges: DataFrame, known: DataFrame, members: str = "members") -> DataFrame:
    """(edge_id, position, source_id, target_id): neighbours among the known members of each hyperedge, in their order."""
    m = edges.select("edge_id", F.posexplode(members).alias("p", "member")).join(known.select(F.col("unit_id").alias("member")), "member", "left_semi")
    w = Window.partitionBy("edge_id").orderBy("p")
    return m.withColumn("target_id", F.lead("member").over(w)).withColumn("position", F.row_number().over(w)).where("target_id is not null").select("edge_id", "position", F.col("member").alias("source_id"), "target_id")


def read_documents(spark: SparkSession, root: str, path: str = ".") -> DataFrame:
    """(path, text) of the readable documents below ``root``: whole files, found in all folders, sensitive ones left out."""
    folder = inside(root, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = F.regexp_replace("path", "^file:/*", "/")
    return found.select(F.substring(at, len(inside(root, ".")) + 2, 10_000).alias("path"), F.decode("content", "UTF-8").alias("text"), at.alias("_full")).where(readable("_full")).drop("_full")


def document_units(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Units of documents (path, text): one per section, named by path, label, version and place."""
    s = sections(docs, "path", "text", stem("path")).join(versions.where("active").select("path", "source_id", "version"), "path")
    subject = F.concat(F.lit("locus:"), F.substring(digest(F.concat_ws(":", "path", "label")), 1, 20))
    unit = F.concat(F.lit("gene:"), F.substring(digest(F.concat(F.col("subject_id"), F.lit(":v"), F.col("version"), F.lit(":"), F.col("ordinal"))), 1, 24))
    return s.withColumn("subject_id", subject).select(
        unit.alias("unit_id"), "subject_id", "label", F.lit("documentation").alias("kind"), F.col("body").alias("content"), F.substring(F.split_part("body", F.lit("\n"), F.lit(1)), 1, 240).alias("summary"),
        "source_id", F.concat_ws(":", "path", "line").alias("source_location"), F.lit("").alias("community"), F.lit(1.0).alias("confidence"),
    )


def read_records(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Units and relations of a file of JSON lines, with the defaults of the fields they lack.

    ``name`` is the path under which the file itself is a source. Blank lines and lines that are no JSON are left out; anything whose
    record_type isn't relation is a unit, and needs content.
    """
    lines = spark.read.text(path).where(F.trim("value", F.lit(BLANKS)) != "")
    rows = lines.select(F.from_json("value", UNIT).alias("r"), F.get_json_object("value", "$.metadata").alias("meta")).select("r.*", "meta")
    r = rows.where("record_type = 'relation' and source_id is not null and target_id is not null")
    edges = r.select("source_id", "target_id", F.coalesce("relation", F.lit("related_to")).alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    u = rows.where("(record_type is null or record_type != 'relation') and content is not null").withColumn("source", F.coalesce("source", F.lit(name)))
    subject = F.coalesce(F.nullif("locus_id", F.lit("")), F.concat(F.lit("locus:"), F.substring(digest(F.concat(F.coalesce("label", F.lit("")), "source")), 1, 20)))
    u = u.withColumn("locus_id", subject)
    unit = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("gene:"), F.substring(digest(F.concat("locus_id", "source", "content")), 1, 24)))
    u = u.withColumn("id", unit)
    return u.select(
        F.col("id").alias("unit_id"), F.col("locus_id").alias("subject_id"), F.coalesce("label", "id").alias("label"), F.coalesce("kind", F.lit("knowledge")).alias("kind"), "content",
        F.coalesce("summary", F.substring("content", 1, 240)).alias("summary"), "source", F.coalesce("source_location", "source").alias("source_location"), F.coalesce("community", F.lit("")).alias("community"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "valid_from", "valid_to", F.coalesce("meta", F.lit("{}")).alias("metadata_json"),
    ), edges


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Units and edges of graph exports: nodes, links (or edges) and hyperedges, whose members are chained.

    An export is a file, or a line of one if ``lines``; equal node keys of several exports name one node.


    Nodes without id and name are left out, and so are links and members that name no node.
    """
    g = spark.read.schema(GRAPH).json(path, multiLine=not lines)
    hashed = lambda c, n: F.substring(digest(c), 1, n)
    n = g.select(F.inline("nodes")).withColumn("key", F.coalesce("id", "name")).where("key != ''")
    label = F.coalesce("label", "name", "key")
    content = F.coalesce("content", "description", label)
    units = n.select(
        F.concat(F.lit(fixed.NODE_ID), hashed("key", 20)).alias("unit_id"), "key", F.concat(F.lit(fixed.NODE_SUBJECT), hashed(F.coalesce("locus", "key"), 16)).alias("subject_id"), label.alias("label"), content.alias("content"),
        F.coalesce("summary", F.substring(content, 1, 240)).alias("summary"), F.coalesce("type", "kind", F.lit("graph_node")).alias("kind"), F.coalesce("source_location", "source_file").alias("source_location"),
        F.coalesce("community", "community_id", F.lit("")).alias("community"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    known = units.select("key", "unit_id").distinct()
    links = g.select(F.inline(F.coalesce("links", "edges"))).select("source", "target", F.coalesce("type", "relation", F.lit("related_to")).alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    pair = lambda df: df.join(known.select(F.col("key").alias("source"), F.col("unit_id").alias("source_id")), "source").join(known.select(F.col("key").alias("target"), F.col("unit_id").alias("target_id")), "target").select("source_id", "target_id", "relation", "confidence")
    h = g.select(F.posexplode("hyperedges").alias("no", "h")).select(F.concat_ws(":", "no", "h.id").alias("edge_id"), F.col("h.members").alias("members"), F.coalesce("h.type", F.lit("hyperedge_member")).alias("relation"), F.coalesce("h.confidence", F.lit(1.0)).alias("confidence"))
    chained = hyperedge_chain(h, known.select(F.col("key").alias("unit_id"))).join(h.drop("members"), "edge_id").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", "confidence")
    return units.drop("key").dropDuplicates(["unit_id"]), pair(links).unionByName(pair(chained))
