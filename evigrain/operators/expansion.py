"""Bounded propagation of scores along relations, in both directions, at most two hops.

Each hop is an equi-join of the scored units with the edges of both directions. The frontier is small against the
edges, and what is sent where is decided by its measured size; a unit that holds a tenth of all edges is split by the
skew handling of the join, and its contributions are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import exact_sum, r10
from evigrain.session import materialise

_ROW = ["run_id", "unit_id"]
#: Names of relations that a bit set has room for.
NAMES = 62
#: Edges of a unit that one task follows; those of a unit with more are parted by the other end.
HUB = 2000


def both_ways(relations: DataFrame) -> DataFrame:
    """(anchor, neighbour, relation, confidence) of every edge from either end; loops and open ends are left out."""
    r = relations.where("source_id is not null and target_id is not null and source_id != target_id")
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"))))
    return r.select("relation", "confidence", ends.alias("e")).select(F.col("e.a").alias("anchor"), F.col("e.b").alias("neighbour"), "relation", "confidence")


def facet_bits(facets) -> Column:
    """Facet numbers as a bit set, which aggregates without building arrays."""
    return F.aggregate(facets, F.lit(0), lambda acc, f: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), f - 1)))


def facet_list(bits) -> Column:
    """The facet numbers of a bit set, ascending."""
    return F.filter(F.sequence(F.lit(1), F.lit(fixed.MAX_FACETS)), lambda f: F.call_function("shiftright", bits, f - 1).bitwiseAND(F.lit(1)) == 1)


def relation_names(edges: DataFrame) -> list[str] | None:
    """The names of relations in order, or nothing where they are more than the bits of a number."""
    names = [x.relation for x in edges.select("relation").distinct().limit(NAMES + 1).collect()]
    return sorted(names) if len(names) <= NAMES else None


def parted(edges: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Edges with ``part``, and (anchor, parts) of the units that have more than one.

    A few bytes of edges become many rows where every run arrives at the same unit; sizes don't tell that before the join.
    """
    hubs = edges.groupBy("anchor").count().where(F.col("count") > hub).select("anchor", F.ceil(F.col("count") / hub).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int"), F.lit(0))
    return edges.join(hubs, "anchor", "left").select(*edges.columns, part.alias("part")), hubs


def contributions(frontier: DataFrame, edges: DataFrame, hop: int, names: list[str] | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(run_id, unit_id, gain, facets, channels): what the neighbours of a frontier receive from it in one hop.

    With the ``names`` of the relations given, those of a neighbour are a bit set, which aggregates without building arrays; an
    empty list leaves channels out. ``hubs`` belong to edges that are ``parted``.
    """
    which = F.collect_set("relation")
    keys = ["anchor"] if hubs is None else ["anchor", "part"]
    if names:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position(F.array(*map(F.lit, names)), F.col("relation")) - 1).cast("int"))
        edges = edges.select(*keys, "neighbour", "confidence", bit.alias("relation"))
        which = F.bit_or("relation")
    near = frontier.select("run_id", F.col("unit_id").alias("anchor"), "score", facet_bits("facets").alias("bits"))
    if hubs is not None:
        near = near.join(hubs, "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    near = near.join(edges, keys)
    gain = F.col("score") * F.col("confidence") * (fixed.HOP_DECAY**hop)
    sums = near.groupBy("run_id", F.col("neighbour").alias("unit_id")).agg(exact_sum(gain).alias("gain"), F.bit_or("bits").alias("bits"), *[which.alias("names")] * (names != []))
    if names == []:
        return sums.select("run_id", "unit_id", "gain", facet_list(F.col("bits")).alias("facets"), F.array().cast("array<string>").alias("channels"))
    if names:
        has = lambda i: F.call_function("shiftright", F.col("names"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
        sums = sums.withColumn("names", F.filter(F.array(*map(F.lit, names)), lambda _, i: has(i)))
    else:
        sums = sums.withColumn("names", F.sort_array("names"))
    label = F.transform("names", lambda n: F.concat(F.lit("graph:"), n, F.lit(f":h{hop}")))
    return sums.select("run_id", "unit_id", "gain", facet_list(F.col("bits")).alias("facets"), label.alias("channels"))


def absorb(seen: DataFrame, got: DataFrame, hop: int) -> DataFrame:
    """``seen`` with the contributions of a hop: scores summed, facets united, channels appended; new units begin at the hop."""
    g = got.select(*_ROW, "gain", F.col("facets").alias("f"), F.col("channels").alias("c"))
    none = lambda t: F.array().cast(f"array<{t}>")
    # what was seen is far less than what a hop gives: hashed, so that the latter isn't sorted
    return seen.hint("shuffle_hash").join(g, _ROW, "full_outer").select(
        *_ROW,
        r10(F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"),
        F.sort_array(F.array_union(F.coalesce("facets", none("int")), F.coalesce("f", none("int")))).alias("facets"),
        F.concat(F.coalesce("channels", none("string")), F.coalesce("c", none("string"))).alias("channels"),
        F.coalesce("protected", F.lit(False)).alias("protected"),
        F.coalesce("depth", F.lit(hop)).alias("depth"),
    )


def expand(candidates: DataFrame, relations: DataFrame, units: DataFrame, hops: int = fixed.MAX_HOPS, named: bool = True) -> DataFrame:
    """Candidates (run_id, unit_id, score, facets, channels, protected) with what they hand on; adds ``depth``.

    A hop starts from the units found first in the hop before and also reaches units that were seen already. Inactive and
    missing units receive nothing. Without ``named``, channels stay as they are.
    """
    ends = both_ways(relations).join(units.where("active").select(F.col("unit_id").alias("neighbour")), "neighbour", "left_semi")
    edges, hubs = map(materialise, parted(materialise(ends, "ends")), ("edges", "hubs"))
    names = relation_names(relations) if named else []
    seen = candidates.withColumn("depth", F.lit(0))
    for hop in range(1, min(hops, fixed.MAX_HOPS) + 1):
        # both the next hop and what was seen read it
        seen = materialise(absorb(seen, contributions(seen.where(F.col("depth") == hop - 1), edges, hop, names, hubs), hop), f"hop{hop}")
    return seen


def dangling(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations with an end that no active unit has, and which end that is."""
    ids = units.where("active").select("unit_id")
    ends = F.explode(F.create_map(F.lit("source_id"), "source_id", F.lit("target_id"), "target_id")).alias("field", "end")
    return relations.select("relation_id", ends).join(ids, F.col("end") == F.col("unit_id"), "left_anti").select("relation_id", "field", F.col("end").alias("missing_id"))
