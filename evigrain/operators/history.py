"""History of each subject as periods of equal content and kind, by gaps and islands (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions.times import iso_instant
from evigrain.sources.tables import BLANKS, current, latest, norm_ref, norm_word, table

OPEN_END = "9999-12-31"


def versions(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """(locus_id, version, gene_id, gene_count, start, end): the periods of each subject in order.

    Content travels as a digest only; ``gene_id`` is the first record of the version, ``end`` is null while open.
    """
    plain = F.trim(F.regexp_replace("content", f"[{BLANKS}]+", " "))
    # null content, which equals only itself, has no mark
    state = F.sha2(F.concat(F.coalesce(norm_word("kind"), F.lit("")), F.lit("\x00"), F.coalesce(F.concat(F.lit("="), plain), F.lit(""))), 256)
    g = genes.select("id", "ingest_seq", norm_ref("locus_id").alias("locus_id"), iso_instant("valid_from").alias("start"), iso_instant("valid_to").alias("until"), norm_ref("source_id").alias("ref"), state.alias("state"))
    g = current(g.where("start is not null and locus_id is not null"), "id", "ingest_seq", "ingest_seq", "locus_id", "start", "until", "ref", "state")
    s = sources.where("id is not null").groupBy(F.col("id").alias("ref")).agg(F.max("version").alias("rank"))
    by = Window.partitionBy("locus_id")
    first = by.orderBy("start", F.desc_nulls_last("rank"), F.desc_nulls_last("ingest_seq"), "id")
    order = by.orderBy("start")
    kept = g.join(s, "ref", "left").withColumn("before", F.lag("start").over(first)).where("before is null or before != start")
    marked = kept.withColumn("new", (~F.lag("state").over(order).eqNullSafe(F.col("state"))).cast("int"))
    islands = marked.withColumn("version", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    v = islands.groupBy("locus_id", "version").agg(
        F.min("start").alias("first"), F.min_by("id", "start").alias("gene_id"), F.count("*").alias("gene_count"), F.max(F.struct("start", "until")).alias("last")
    )
    after = F.lead("first").over(by.orderBy("version"))
    early = (F.col("last.until") > F.col("last.start")) & (F.col("after").isNull() | (F.col("last.until") < F.col("after")))
    return v.withColumn("after", after).select(
        "locus_id", "version", "gene_id", "gene_count", F.col("first").alias("start"), F.when(early, F.col("last.until")).otherwise(F.col("after")).alias("end")
    )


def _period(v: DataFrame) -> DataFrame:
    """Dates in UTC, whatever the time zone of the session."""
    zone = F.current_timezone()
    day = lambda c: F.date_format(F.convert_timezone(zone, F.lit("UTC"), F.col(c).cast("timestamp_ntz")), "yyyy-MM-dd")
    return v.withColumn("version_from", day("start")).withColumn("version_to", F.coalesce(day("end"), F.lit(OPEN_END)))


def p5_found(spark, folder: str) -> DataFrame:
    v = versions(table(spark, folder, "genes"), table(spark, folder, "sources"))
    return _period(v).select("locus_id", "version_from", "version_to")


def p5_history(spark, folder: str) -> DataFrame:
    """The whole history: each version of a subject with its period, content and kind as its first record has them."""
    genes = table(spark, folder, "genes")
    v = _period(versions(genes, table(spark, folder, "sources")))
    text = latest(genes, "id", "ingest_seq", "content", "kind").select(F.col("id").alias("gene_id"), "content", norm_word("kind").alias("kind"))
    return v.join(text, "gene_id").select("locus_id", "version", "version_from", "version_to", "gene_id", "gene_count", "kind", "content")
