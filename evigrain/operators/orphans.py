"""Orphan references: what names a record that is absent, deleted or created only later (problem 4).

References run from relations to genes and from genes to sources. A reference is direct when its own target is missing.
From the records that hold direct ones the cascade goes down the foreign keys: whatever refers to an orphaned record is
orphaned by inheritance, round by round, until a round adds nothing. Rounds are semi-joins on narrow rows, written to the
shared folder, so lineage doesn't grow; how deep the references go isn't assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.session import materialise
from evigrain.sources.tables import current, norm_ref, table

_FIELDS = ["ref_table", "ref_field", "record_id", "created_at", "parent_table", "parent_id", "reason"]


def settled_genes(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each gene once: (id, first, created_at, active, ref, reason); reason is that of its source reference."""
    now = F.max(F.struct(F.coalesce("ingest_seq", F.lit(-(2**63))).alias("s"), "created_at", "active", norm_ref("source_id").alias("ref")))
    g = (
        genes.where("id is not null")
        .groupBy("id")
        .agg(F.min("created_at").alias("first"), now.alias("m"))
        .select("id", "first", "m.created_at", "m.active", "m.ref")
    )
    s = sources.where("id is not null").groupBy(F.col("id").alias("ref")).agg(F.min("created_at").alias("since"), F.lit(True).alias("there"))
    reason = F.when(F.col("ref").isNull(), None).when(F.col("there").isNull(), "absent").when(F.col("since") > F.col("created_at"), "later")
    return g.join(s, "ref", "left").select("id", "first", "created_at", "active", "ref", reason.alias("reason"))


def references(genes: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """Every reference of the current deliveries that names something, with the reason why it is an orphan or null.

    The reasons are looked for in this order: absent, deleted, later. Equal times are no case.
    """
    g = settled_genes(genes, sources)
    own = g.where("ref is not null").select(
        F.lit("genes").alias("ref_table"), F.lit("source_id").alias("ref_field"), F.col("id").alias("record_id"), "created_at", F.lit("sources").alias("parent_table"), F.col("ref").alias("parent_id"), "reason"
    )
    ends = F.explode(F.create_map(F.lit("source_id"), norm_ref("source_id"), F.lit("target_id"), norm_ref("target_id"))).alias("ref_field", "ref")
    r = current(relations, "id", "ingest_seq", "source_id", "target_id", "created_at").select(F.col("id").alias("record_id"), "created_at", ends)
    target = g.select(F.col("id").alias("ref"), F.lit(True).alias("there"), "first", "active")
    reason = F.when(F.col("there").isNull(), "absent").when(~F.col("active"), "deleted").when(F.col("first") > F.col("created_at"), "later")
    rel = (
        r.where("ref is not null")
        .join(target, "ref", "left")
        .select(F.lit("relations").alias("ref_table"), "ref_field", "record_id", "created_at", F.lit("genes").alias("parent_table"), F.col("ref").alias("parent_id"), reason.alias("reason"))
    )
    return own.unionByName(rel).select(*_FIELDS)


def cascade(refs: DataFrame) -> DataFrame:
    """(ref_table, record_id, level) of each orphaned record: 0 by a reference of its own, else the round that reached it.

    Circular references end too, since a record is reached once.
    """
    level = 0
    seen = front = materialise(refs.where("reason is not null").select("ref_table", "record_id").distinct().withColumn("level", F.lit(0)), "orphans")
    links = refs.where("reason is null").select("ref_table", "record_id", "parent_table", "parent_id")
    while True:
        level += 1
        parents = front.select(F.col("ref_table").alias("parent_table"), F.col("record_id").alias("parent_id"))
        reached = links.join(parents, ["parent_table", "parent_id"], "left_semi").select("ref_table", "record_id").distinct()
        front = materialise(reached.join(seen, ["ref_table", "record_id"], "left_anti").withColumn("level", F.lit(level)), "orphans")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def inherited(refs: DataFrame) -> DataFrame:
    """``refs`` with ``inherited``: the target is there, but is orphaned itself."""
    lost = cascade(refs).select(F.col("ref_table").alias("parent_table"), F.col("record_id").alias("parent_id"), F.lit(True).alias("lost"))
    return refs.join(lost, ["parent_table", "parent_id"], "left").withColumn("inherited", F.col("reason").isNull() & F.coalesce("lost", F.lit(False))).drop("lost")


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return references(*[table(spark, folder, t) for t in ("genes", "relations", "sources")])


def p4_found(spark, folder: str) -> DataFrame:
    return _all(spark, folder).where("reason is not null").select("ref_table", "ref_field", "record_id")


def p4_totals(spark, folder: str) -> DataFrame:
    """References, orphans by reason and inherited orphans per table, field and month of the referring row (UTC)."""
    count = lambda c: F.count(F.when(c, True))
    return (
        inherited(materialise(_all(spark, folder), "references"))
        .groupBy("ref_table", "ref_field", F.date_format("created_at", "yyyy-MM").alias("month"))
        .agg(
            F.count("*").alias("refs"),
            count(F.col("reason").isNotNull()).alias("direct"),
            *[count(F.col("reason") == x).alias(x) for x in ("absent", "deleted", "later")],
            count(F.col("inherited")).alias("inherited"),
        )
    )


def p4_cascade(spark, folder: str) -> DataFrame:
    """(ref_table, record_id, level): each orphaned record, direct ones at level 0."""
    return cascade(materialise(_all(spark, folder), "references"))
