"""Resolution of candidates to the current version of their subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import exact_sum, r10
from evigrain.operators.expansion import facet_bits, facet_list


def replacements(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """(run_id, old_id, unit_id): every current version of the subject of each candidate whose state is historical."""
    old = units.where("state = 'historical'").select(F.col("unit_id").alias("old_id"), "subject_id")
    new = units.where("active and state = 'current'").select("unit_id", "subject_id")
    return candidates.select("run_id", F.col("unit_id").alias("old_id")).join(old, "old_id").join(new, "subject_id").select("run_id", "old_id", "unit_id")


def resolve(candidates: DataFrame, units: DataFrame, named: bool = True) -> DataFrame:
    """Candidates of runs whose mode is current, with the current versions of historical ones added.

    A version inherits 1.08 times the score of each version it replaces, its facets and its protection. The versions that were
    replaced stay; scoring excludes them. Without ``named``, channels stay as they are.
    """
    old = units.where("state = 'historical'").select("unit_id", "subject_id")
    new = units.where("active and state = 'current'").select(F.col("unit_id").alias("new_id"), "subject_id")
    asked = candidates.where("temporal_mode = 'current'").select("run_id", "unit_id", "score", facet_bits("facets").alias("bits"), "protected")
    gain = (
        asked.join(old.hint("shuffle_hash"), "unit_id")
        .join(new, "subject_id")
        .groupBy("run_id", F.col("new_id").alias("unit_id"))
        .agg(exact_sum(F.col("score") * fixed.VERSION_BOOST).alias("gain"), F.bit_or("bits").alias("bits"), (F.sort_array(F.collect_set("unit_id")) if named else F.array().cast("array<string>")).alias("from"), F.max("protected").alias("p"))
        .select("run_id", "unit_id", "gain", facet_list(F.col("bits")).alias("f"), F.transform("from", lambda x: F.concat(F.lit("temporal:current-allele:"), x)).alias("c"), "p")
    )
    none = lambda t: F.array().cast(f"array<{t}>")
    # the smaller side is hashed, so that the candidates aren't sorted
    return candidates.drop("temporal_mode").join(gain.hint("shuffle_hash"), ["run_id", "unit_id"], "full_outer").select(
        "run_id", "unit_id",
        r10(F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"),
        F.sort_array(F.array_union(F.coalesce("facets", none("int")), F.coalesce("f", none("int")))).alias("facets"),
        F.concat(F.coalesce("channels", none("string")), F.coalesce("c", none("string"))).alias("channels"),
        (F.coalesce("protected", F.lit(False)) | F.coalesce("p", F.lit(False))).alias("protected"),
    )


def superseded(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates of current mode that are historical and drop out, with their subject and whether it has a current version."""
    now = units.where("active and state = 'current'").select("subject_id").distinct().withColumn("replaced", F.lit(True))
    old = candidates.where("temporal_mode = 'current'").join(units.where("state = 'historical'").select("unit_id", "subject_id"), "unit_id")
    return old.join(now, "subject_id", "left").select("run_id", "unit_id", "subject_id", F.coalesce("replaced", F.lit(False)).alias("replaced"))
