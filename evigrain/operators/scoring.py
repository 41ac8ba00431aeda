"""Exclusion of candidates, their score by bounded modifiers, and the threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import r10
from evigrain.functions.text import fold, render, token_estimate, unit_forms

from evigrain.session import materialise

#: What a text costs, as a column expression.
Cost = Callable[[Column], Column]


def _decimal(c: Column) -> Column:
    """A number with three places."""
    return c.cast("decimal(20,12)").cast("decimal(12,3)").cast("string")


def features(units: DataFrame, vocabulary: DataFrame, cost: Cost = token_estimate) -> DataFrame:
    """What scoring needs of each unit: its tokens as rendered, by ``cost``, and which forms of a vocabulary it has; no texts."""
    hits = units.select("unit_id", F.explode_outer(unit_forms(units)).alias("form")).join(vocabulary, "form", "left_semi").groupBy("unit_id").agg(F.collect_list("form").alias("forms"))
    u = units.select("unit_id", "subject_id", "label", "kind", "source_id", "source_location", "confidence", "state", cost(render()).alias("tokens"))
    return u.join(hits, "unit_id", "left").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))


def regulate(candidates: DataFrame, runs: DataFrame, units: DataFrame, sources: DataFrame, marks: DataFrame, cost: Cost = token_estimate) -> DataFrame:
    """Every candidate with its score and what made it, or with the reason why it is excluded. Rows are narrow: texts and
    citations are looked up for what is selected.

    ``runs`` has (run_id, question_id, budget, use_marks, use_suppressors, use_packing) and the plan of the question.
    """
    return settle(assess(candidates, runs, units, sources, marks, cost).join(runs.select("run_id", "use_marks", "use_suppressors", "use_packing"), "run_id"))


def assess(candidates: DataFrame, runs: DataFrame, units: DataFrame, sources: DataFrame, marks: DataFrame, cost: Cost = token_estimate, whole: bool = False) -> DataFrame:
    """What score and exclusion of every candidate rest on, whatever the flags of a run: done once for all methods of a question.

    ``base`` is the score multiplied by confidence, lexical coverage, recency of the source and task, in this order. Units are
    read once, however many runs they are candidates of. With ``whole``, features are those of all units, and ``candidates`` are read once.
    """
    vocabulary = runs.select(F.explode_outer(F.array_union("query_terms", "negatives")).alias("form")).distinct()
    mine = units if whole else units.join(candidates.select("unit_id").distinct(), "unit_id", "left_semi")
    u = materialise(features(mine, vocabulary, cost), "features")
    s = sources.select("source_id", F.col("active").alias("source_active"), F.lit(True).alias("source_known"))
    m = marks.select("unit_id", "boost", "suppressed")
    r = runs.select("run_id", "question_id", "task", "temporal_mode", "negatives", "query_terms", "facet_count", "core_forms", "budget")
    # a task has its kinds, so a unit has its tasks; the plans of the runs, which are wide, come last and aren't shuffled
    tasks = [F.when(fold("kind").isin(list(map(str, kinds))), F.lit(t)) for t, kinds in fixed.TASK_KINDS.items()]
    u = u.withColumn("tasks", F.filter(F.array(*tasks), lambda t: t.isNotNull())).join(s, "source_id", "left").join(m, "unit_id", "left").select(
        "unit_id", "confidence", "state", "tokens", "forms", "tasks", "source_active", "source_known", "boost", "suppressed"
    )
    # features are hashed, so that the candidates aren't sorted
    c = candidates.join(u.hint("shuffle_hash"), "unit_id").join(r, "run_id")
    c = c.withColumn("barred", F.sort_array(F.array_intersect("forms", "negatives")))
    c = c.withColumn("matched", F.sort_array(F.array_intersect("forms", "query_terms")))
    coverage = F.size("matched") / F.greatest(F.lit(1), F.size("query_terms"))
    fits = F.array_contains("tasks", F.col("task"))
    recent = F.when(F.col("source_active"), F.lit(fixed.SOURCE_CURRENT)).when(F.col("source_known"), F.lit(fixed.SOURCE_OLD))
    score = (
        F.col("score")
        * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
        * (0.5 + 0.5 * coverage)
        * F.coalesce(recent, F.lit(1.0))
        * F.when(fits, F.lit(fixed.TASK_BOOST)).otherwise(F.lit(1.0))
    )
    core = F.filter("facets", lambda f: F.arrays_overlap(F.element_at("core_forms", f), F.col("matched")))
    past = (F.col("temporal_mode") == "current") & (F.col("state") == "historical")
    return c.select(
        "run_id", "question_id", "unit_id", score.alias("base"), "facets", core.alias("core_facets"), "matched", "barred", "protected", past.alias("past"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"), "tokens", "budget", "facet_count",
        coverage.alias("coverage"), "state", F.coalesce(fits, F.lit(False)).alias("fits"), "boost", F.coalesce("source_active", F.lit(False)).alias("source_active"), F.col("source_known").isNotNull().alias("source_known"),
    )


def verdict(use_marks: Column, use_suppressors: Column) -> tuple[Column, Column, Column]:
    """Score, exclusion and feedback of an assessed candidate under the flags of a method.

    The first that holds excludes: a suppressed term, a superseded version, an explicit suppression. Feedback is the last factor
    of the score.
    """
    # without feedback there are no marks, and so no explicit suppression either
    boost, hidden = F.when(use_marks, F.col("boost")), use_marks & use_suppressors & F.col("suppressed")
    excluded = (
        F.when(use_suppressors & (F.size("barred") > 0), "repressor matched")
        .when(F.col("past"), "historical allele superseded")
        .when(hidden, "explicitly suppressed")
    )
    return r10(F.col("base") * (1.0 + F.coalesce(boost, F.lit(0.0)))), excluded, boost


def settle(assessed: DataFrame) -> DataFrame:
    """Assessed candidates, with the flags of their runs, with score and exclusion."""
    score, excluded, boost = verdict(F.col("use_marks"), F.col("use_suppressors"))
    return assessed.select(
        "run_id", "question_id", "unit_id", score.alias("score"), "facets", "core_facets", "matched", "barred", "protected", excluded.alias("excluded"), "tokens", "budget", "facet_count", "use_packing",
        "coverage", "state", "fits", boost.alias("boost"), "source_active", "source_known",
    )


def reasons(rows: DataFrame) -> DataFrame:
    """Scored rows, with the channels and the task of their run, with ``reasons``: what made each score, in order."""
    some = lambda *x: F.filter(F.array(*x), lambda y: y.isNotNull())
    low = F.col("use_packing") & (F.col("score") + fixed.EPSILON < F.col("floor"))
    made = F.concat(
        F.transform("channels", lambda x: F.concat(F.lit("promoter="), x)),
        some(
            F.concat(F.lit("lexical-coverage="), _decimal(F.col("coverage"))), F.concat(F.lit("temporal="), "state"),
            F.when(F.col("source_known"), F.when(F.col("source_active"), "source=current").otherwise("source=historical")),
            F.when(F.col("fits"), F.concat(F.lit("task="), "task")), F.when(F.col("boost").isNotNull(), F.concat(F.lit("epigenetic="), F.when(F.col("boost") >= 0, "+").otherwise(""), _decimal(F.col("boost")))),
            F.when(low, F.when(F.size("core_facets") > 0, "core-facet-protected").otherwise("facet-protected")),
        ),
    )
    return rows.withColumn("reasons", made)


def floors(scored: DataFrame) -> DataFrame:
    """(run_id, floor): 0.70 of the best score of each run that packs by coverage."""
    return scored.where("excluded is null and use_packing").groupBy("run_id").agg((F.max("score") * fixed.EXPRESSION_RATIO).alias("floor"))


def threshold(scored: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``scored`` with what falls below 0.70 of the run's best score excluded, unless it is protected or matches a core term.

    Only runs that pack by coverage have a threshold. The best score is an aggregate joined back, one row per run, so that no run
    gathers in one task; ``kept`` are the ``floors``, where they are known.
    """
    c = scored.join(floors(scored) if kept is None else kept, "run_id", "left")
    intent = F.col("protected") | (F.size("core_facets") > 0)
    low = F.col("excluded").isNull() & F.col("use_packing") & (F.col("score") + fixed.EPSILON < F.col("floor"))
    return c.withColumn("excluded", F.when(low & ~intent, "expression threshold").otherwise(F.col("excluded"))).withColumn("floor", r10("floor"))


def term_weights(expressed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, term, weight) of each query term by how few of the expressed candidates match it."""
    c = expressed.where("excluded is null")
    n = c.groupBy("run_id").agg(F.count("*").alias("n")).join(runs.select("run_id", F.col("query_terms").alias("q")), "run_id")
    df = c.select("run_id", F.explode_outer("matched").alias("term")).groupBy("run_id", "term").agg(F.count("*").alias("df"))
    asked = n.select("run_id", "n", F.explode_outer("q").alias("term"))
    weight = F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1.0
    return asked.join(df, ["run_id", "term"], "left").select("run_id", "term", r10(weight).alias("weight"))


__all__ = ["assess", "floors", "reasons", "regulate", "settle", "term_weights", "threshold"]
