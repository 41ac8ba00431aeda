"""Table scans and the delivery rules that hold for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space around ids and labels.
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0                　"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_ref(c: Column | str) -> Column:
    """A referring id as it is compared: trimmed and lower-cased; an empty reference is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c, F.lit(BLANKS))), F.lit(""))


def norm_word(c: Column | str) -> Column:
    """A category value (kind, relation, language) trimmed and lower-cased; blank is null."""
    return norm_ref(c)


def current(df: DataFrame, key: str = "id", seq: str = "ingest_seq", *columns: str) -> DataFrame:
    """The current delivery of each record: the one with the highest sequence number.

    ``columns`` limits what travels through the aggregation. Rows with a null key are dropped (they identify
    nothing); a null sequence counts as lowest. The aggregation combines on the map side, so a key that is
    delivered very often never gathers in one task. Equal sequence numbers are broken by the values themselves.
    """
    cols = [c for c in (columns or df.columns) if c != key]
    order = F.struct(F.coalesce(F.col(seq), F.lit(-(2**63))).alias("s"), *[F.col(c) for c in cols])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(order).alias("_m"))
        .select(key, *[F.col(f"_m.{c}").alias(c) for c in cols])
    )


def latest(df: DataFrame, key: str = "id", seq: str = "ingest_seq", *columns: str) -> DataFrame:
    """As ``current``, for rows that hold long texts: only records that were delivered more than once are aggregated.

    The ids of those are found on the two narrow columns; the others pass as they are, and where that list is small
    enough for Spark to send it to the executors their texts aren't shuffled at all. Each frame is scanned twice.
    """
    cols = [c for c in (columns or df.columns) if c not in (key, seq)]
    rows = df.where(F.col(key).isNotNull()).select(key, seq, *cols)
    again = rows.groupBy(key).count().where("count > 1").select(key)
    once = rows.join(again, key, "left_anti")
    more = current(rows.join(again, key, "left_semi"), key, seq, seq, *cols)
    return once.unionByName(more)
