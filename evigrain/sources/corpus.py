"""The store as the engine sees it: units, relations, sources and feedback marks, each record once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.text import fold, unit_forms
from evigrain.functions.times import iso_instant
from evigrain.session import materialise, together
from evigrain.sources.tables import latest, norm_ref, table

#: The moment against which validity is judged where none is given: behind all dates of records, so results repeat.
NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)

EVENT_TYPES = {
    "purchase": "feedback.accepted", "error": "feedback.rejected", "signup": "mark.suppressed", "view": "mark.unsuppressed", "click": "gene.ingested",
}


def temporal_state(now: Column, status: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """historical, current or unknown: by status, else by the end of validity (an unreadable one is past), else by its start."""
    s = fold(F.coalesce(status, F.lit("")))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ended = ~F.coalesce(iso_instant(valid_to) > now, F.lit(False))
    return (
        F.when(s.isin(fixed.STATUS_HISTORICAL), "historical")
        .when(s.isin(fixed.STATUS_CURRENT), "current")
        .when(given(valid_to) & ended, "historical")
        .when(given(valid_from) & ~given(valid_to), "current")
        .otherwise("unknown")
    )


def units(genes: DataFrame, now: datetime = NOW) -> DataFrame:
    """Each unit once, as last delivered; null texts are empty, a null confidence is 1, metadata that can't be read has no status.

    ``active`` is false only where it says so. Extra columns are dropped.
    """
    g = latest(genes, "id", "ingest_seq", "locus_id", "label", "kind", "content", "summary", "source_id", "source_location", "community",
               "confidence", "valid_from", "valid_to", "metadata_json", "content_hash", "active", "created_at")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    status = F.get_json_object("metadata_json", "$.status")
    return g.select(
        F.col("id").alias("unit_id"), F.coalesce(norm_ref("locus_id"), F.lit("")).alias("subject_id"), text("label"), text("kind"), text("content"), text("summary"),
        F.coalesce(norm_ref("source_id"), F.lit("")).alias("source_id"), text("source_location"), text("community"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "valid_from", "valid_to", "content_hash", F.coalesce("active", F.lit(True)).alias("active"), "created_at",
        F.col("ingest_seq"), status.alias("status"), temporal_state(F.lit(now), status).alias("state"),
    )


def relations(rows: DataFrame) -> DataFrame:
    """Each relation once, endpoints as they are compared; a null confidence is 1, a null name related_to."""
    r = latest(rows, "id", "ingest_seq", "source_id", "target_id", "relation", "confidence")
    return r.select(
        F.col("id").alias("relation_id"), norm_ref("source_id").alias("source_id"), norm_ref("target_id").alias("target_id"),
        F.coalesce("relation", F.lit("related_to")).alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "ingest_seq",
    )


def sources(rows: DataFrame) -> DataFrame:
    """Each source version once; of unequal deliveries the one created last, active before not."""
    top = F.max(F.struct("created_at", "active", "version", "path", "content_hash"))
    return rows.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(top.alias("m")).select(
        "source_id", "m.path", "m.content_hash", "m.version", "m.created_at", F.coalesce("m.active", F.lit(False)).alias("active")
    )


def audit_events(events: DataFrame, u: DataFrame) -> DataFrame:
    """The event table read as an audit log: (seq, event_id, event_type, unit_id, value, created_at).

    An event concerns the unit whose sequence number is its user; users without one concern no unit.
    """
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    e = events.select(F.col("event_id").alias("seq"), F.concat(F.lit("evt:"), F.col("event_id")).alias("event_id"), F.coalesce(kind[F.col("event_type")], "event_type").alias("event_type"),
                      F.col("user_id").alias("ingest_seq"), "value", F.col("ts").alias("created_at"))
    return e.join(u.select("unit_id", "ingest_seq"), "ingest_seq", "left").drop("ingest_seq")


@dataclass(frozen=True)
class Corpus:
    units: DataFrame
    relations: DataFrame
    sources: DataFrame
    marks: DataFrame


def held(c: Corpus) -> Corpus:
    """A corpus written to the shared folder once, with the forms of each unit: for what reads it again and again."""
    frames = {"units": c.units.withColumn("forms", unit_forms(c.units)), "relations": c.relations, "sources": c.sources, "marks": c.marks}
    return Corpus(*together(c.units.sparkSession, *[partial(materialise, df, name) for name, df in frames.items()]))


def corpus(spark: SparkSession, folder: str, now: datetime = NOW) -> Corpus:
    """The test tables as a corpus."""
    from evigrain.operators.audit import marks

    u = units(table(spark, folder, "genes"), now)
    return Corpus(u, relations(table(spark, folder, "relations")), sources(table(spark, folder, "sources")), marks(audit_events(table(spark, folder, "events"), u)))
