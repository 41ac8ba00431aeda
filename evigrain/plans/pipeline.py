"""The whole retrieval: many questions, each under its budget and feature flags, in one plan.

Stages that are read more than once are written to the shared folder: they are small (candidates, not texts), and
what follows keeps exact statistics for its joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import r10
from evigrain.functions.questions import facet_rows, plan
from evigrain.functions.text import forms_of, token_estimate
from evigrain.operators import channels, expansion, packing, scoring, temporal
from evigrain.session import materialise
from evigrain.sources.corpus import Corpus

#: Feature flags of each method of the evaluation that uses the pipeline: graph, marks, suppressors, packing by coverage.
METHODS = {
    "main": (True, True, True, True),
    "graph_baseline": (True, False, False, False),
    "ablation_no_marks": (True, False, True, True),
    "ablation_no_suppressors": (True, True, False, True),
    "ablation_no_packing": (True, True, True, False),
    "ablation_channels_only": (False, False, False, False),
}


@dataclass(frozen=True)
class Retrieval:
    """Every stage of a retrieval, each a frame of its own; ``picked`` is the part of ``packed`` that was selected, ``best`` and ``traced`` are its rows of ``scored`` and ``candidates``.

    ``candidates``, ``scored`` and ``packed`` of all runs are worked out from what is written once per question when they are read.
    """

    runs: DataFrame
    fused: DataFrame
    candidates: DataFrame
    scored: DataFrame
    packed: DataFrame
    picked: DataFrame
    best: DataFrame
    traced: DataFrame
    corpus: Corpus

    def contexts(self) -> DataFrame:
        return packing.contexts(self.best, self.picked, self.corpus.units)

    def selected(self) -> DataFrame:
        return packing.selected_payload(self.best, self.picked, self.traced, self.runs, self.corpus.units, self.corpus.sources)

    def excluded(self) -> DataFrame:
        return packing.excluded_payload(self.scored, self.packed)

    def metrics(self) -> DataFrame:
        """(run_id, question_id, ...): tokens, use of the budget, counts and facets covered of each run."""
        c = self.scored.groupBy("run_id").agg(F.count("*").alias("candidate_count"), F.count(F.when(F.col("excluded").isNull(), 1)).alias("expressed_count"))
        s = self.picked.join(self.best.select("run_id", "unit_id", "tokens", "facets"), ["run_id", "unit_id"]).groupBy("run_id").agg(
            F.sum("tokens").alias("context_tokens"), F.count("*").alias("selected_count"), F.size(F.array_distinct(F.flatten(F.collect_set("facets")))).alias("covered_facets")
        )
        zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
        m = self.runs.select("run_id", "question_id", "budget", "facet_count").join(c, "run_id", "left").join(s, "run_id", "left")
        m = m.select("run_id", "question_id", F.col("budget").cast("bigint").alias("budget"), F.col("facet_count").cast("bigint").alias("facet_count"), *map(zero, ("candidate_count", "expressed_count", "context_tokens", "selected_count", "covered_facets")))
        return m.withColumn("excluded_count", F.col("candidate_count") - F.col("selected_count")).withColumn("budget_utilization", r10(F.col("context_tokens") / F.col("budget")))


def check_budget(questions: DataFrame) -> DataFrame:
    """``questions`` with the default where no budget is given; one below 1 is an error when the row is read."""
    budget = F.coalesce("budget", F.lit(fixed.DEFAULT_BUDGET))
    return questions.withColumn("budget", F.when(budget >= 1, budget).otherwise(F.raise_error(F.lit("budget must be positive")).cast("int")))


def planned(questions: DataFrame) -> DataFrame:
    return plan(check_budget(questions)).withColumn("core_forms", F.transform("facets", lambda f: forms_of(F.slice(f, 1, 1))))


def expand_methods(p: DataFrame, methods: dict[str, tuple[bool, bool, bool, bool]]) -> DataFrame:
    """One run per question and method; its id is the question's, and the method's unless there is only one."""
    flags = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[F.lit(v).alias(n) for n, v in zip(("use_graph", "use_marks", "use_suppressors", "use_packing"), f)]) for m, f in methods.items()])).alias("f")
    rows = p.select("*", flags).select("*", "f.*").drop("f")
    return rows.withColumn("run_id", F.col("question_id") if len(methods) == 1 else F.concat_ws("|", "question_id", "method"))


def expand_routes(p: DataFrame, methods: dict[str, tuple[bool, bool, bool, bool]]) -> DataFrame:
    """One row per question and way of finding candidates: with or without the graph. Methods that differ in other flags share theirs."""
    ways = sorted({f[0] for f in methods.values()})
    rows = p.withColumn("use_graph", F.explode(F.array(*map(F.lit, ways))))
    return rows.withColumn("run_id", F.col("question_id") if len(ways) == 1 else F.concat_ws("|", "question_id", F.when(F.col("use_graph"), "graph").otherwise("channels")))


def by_run(rows: DataFrame, methods: dict[str, tuple[bool, bool, bool, bool]], *columns: str) -> DataFrame:
    """Rows of routes (question_id, use_graph, ...) once for each run whose method takes the route, with its id and flags."""
    one = lambda m, f: F.struct(F.lit(m).alias("method"), *[F.lit(v).alias(n) for n, v in zip(("use_marks", "use_suppressors", "use_packing"), f[1:])])
    taken = lambda graph: F.array(*[one(m, f) for m, f in methods.items() if f[0] == graph])
    if len({f[0] for f in methods.values()}) == 2:
        flags = F.when(F.col("use_graph"), taken(True)).otherwise(taken(False))
    else:
        flags = F.array(*[one(m, f) for m, f in methods.items()])
    run = F.col("question_id") if len(methods) == 1 else F.concat_ws("|", "question_id", "f.method")
    return rows.select(*columns, "question_id", F.explode(flags).alias("f")).select(*columns, "question_id", run.alias("run_id"), "f.use_marks", "f.use_suppressors", "f.use_packing")


def recall(p: DataFrame, units: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Fused candidates of planned questions, with the fallback of those that no channel found anything for."""
    fused = channels.fuse(materialise(channels.rankings(facet_rows(p), units, k), "rankings"))
    fused = materialise(fused, "fused")
    if p.join(fused.select("question_id").distinct(), "question_id", "left_anti").isEmpty():
        return fused
    return fused.unionByName(channels.fallback(p, fused, units, k))


def spread(fused: DataFrame, runs: DataFrame, corpus: Corpus, hops: int = fixed.MAX_HOPS, named: bool = True) -> DataFrame:
    """Candidates of each run after expansion and version resolution, as its flags and mode ask; without ``named``, channels are those of the search only."""
    c = runs.select("run_id", "question_id", "use_graph", "temporal_mode").join(fused, "question_id")
    cols = ["run_id", "unit_id", "score", "facets", "channels", "protected"]
    out = expansion.expand(c.where("use_graph").select(*cols), corpus.relations, corpus.units, hops, named).select(*cols).unionByName(c.where("not use_graph").select(*cols))
    return temporal.resolve(out.join(runs.select("run_id", "temporal_mode"), "run_id"), corpus.units, named)


def retrieve(questions: DataFrame, corpus: Corpus, methods: dict[str, tuple[bool, bool, bool, bool]] | None = None, k: int = fixed.TOP_K, hops: int = fixed.MAX_HOPS, cost: scoring.Cost = token_estimate) -> Retrieval:
    """Answer all ``questions`` (question_id, query, budget): candidates, scores, selection and reasons.

    Question ids are unique and not null. Null and empty queries find the first units, as any label contains
    nothing; a null budget is the default one. Empty tables give empty results. ``cost`` counts the tokens of a rendered unit;
    the tokens of a context are taken for their sum.
    """
    methods = methods or {"main": METHODS["main"]}
    p = materialise(planned(questions.select("question_id", "query", "budget")), "plan")
    runs, routes = expand_methods(p, methods), expand_routes(p, methods)
    fused = recall(p, corpus.units, k)
    # candidates are found and assessed once per question and route; what the flags of a method change is a step without a join
    found = materialise(spread(fused, routes, corpus, hops), "candidates")
    way = routes.select("run_id", "question_id", "use_graph")
    spread_out = lambda rows: by_run(rows.join(way, "run_id").drop("run_id"), methods, *[c for c in rows.columns if c != "run_id"]).select(*rows.columns)
    assessed = scoring.assess(found, routes, corpus.units, corpus.sources, corpus.marks, cost).join(way.drop("question_id"), "run_id").drop("run_id")
    assessed = materialise(assessed, "assessed")
    settle = lambda rows: scoring.settle(by_run(rows, methods, *[c for c in rows.columns if c not in ("question_id", "use_graph")]))
    floors = materialise(scoring.floors(settle(assessed)), "floors")
    scored = scoring.threshold(settle(assessed), floors)
    done, lost = [], None
    if any(f[3] for f in methods.values()):
        done.append(materialise(packing.pack_by_coverage(scored, corpus.units), "packed"))
    if not all(f[3] for f in methods.values()):
        done.append(materialise(packing.pack_by_score(scored), "packed"))
        lost = packing.lost_by_score(scored, done[-1])
    packed = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    # selections are few; joins with them need no shuffle of the candidates
    picked = materialise(packed.where("rank is not null"), "picked")
    units = picked.select("unit_id").distinct()
    few = lambda rows: rows.join(units, "unit_id", "left_semi")
    best = materialise(scoring.threshold(settle(few(assessed)), floors).join(picked.select("run_id", "unit_id"), ["run_id", "unit_id"], "left_semi"), "best")
    return Retrieval(runs, fused, spread_out(found), scored, packed if lost is None else packed.unionByName(lost), picked, best, spread_out(few(found)), corpus)


def select(questions: DataFrame, corpus: Corpus, methods: dict[str, tuple[bool, bool, bool, bool]], k: int = fixed.TOP_K, hops: int = fixed.MAX_HOPS, cost: scoring.Cost = token_estimate) -> DataFrame:
    """(question_id, method, unit_id, rank, valid): what ``retrieve`` selects by each method, and whether its citation holds.

    Nothing is explained, so candidates carry no channels, and of those that can't be selected no row goes on to the methods: below the
    threshold of every method without protection or a core term, or behind too many others in the order of the score.
    """
    p = materialise(planned(questions.select("question_id", "query", "budget")), "plan")
    runs, routes = expand_methods(p, methods), expand_routes(p, methods)
    found = spread(recall(p, corpus.units, k).withColumn("channels", F.array().cast("array<string>")), routes, corpus, hops, named=False)
    way = routes.select("run_id", "use_graph")
    columns = ["unit_id", "base", "facets", "core_facets", "matched", "barred", "protected", "past", "suppressed", "tokens", "budget", "facet_count", "boost"]
    assessed = scoring.assess(found, routes, corpus.units, corpus.sources, corpus.marks, cost, whole=True).join(way, "run_id").select("question_id", "use_graph", *columns)
    assessed = materialise(assessed, "assessed")
    run = lambda m: F.col("question_id") if len(methods) == 1 else F.concat_ws("|", "question_id", F.lit(m))
    verdicts = {m: scoring.verdict(F.lit(f[1]), F.lit(f[2])) for m, f in methods.items()}
    good = {m: (F.col("use_graph") == f[0]) & verdicts[m][1].isNull() for m, f in methods.items()}
    packed = []
    if some := [m for m, f in methods.items() if f[3]]:
        best = [(F.max(F.when(good[m], verdicts[m][0])) * fixed.EXPRESSION_RATIO).alias(f"floor_{m}") for m in some]
        floors = materialise(assessed.groupBy("question_id").agg(*best), "floors")
        intent, keep = F.col("protected") | (F.size("core_facets") > 0), F.lit(False)
        for m in some:
            keep = keep | (good[m] & (intent | (verdicts[m][0] + fixed.EPSILON >= F.col(f"floor_{m}"))))
        kept = materialise(assessed.join(floors, "question_id").where(keep).select("question_id", "use_graph", *columns), "expressed")
        per_run = floors.select(F.explode(F.array(*[F.struct(run(m).alias("run_id"), F.col(f"floor_{m}").alias("floor")) for m in some])).alias("f")).select("f.*").where("floor is not null")
        # what only explanations ask for
        blank = {"coverage": "double", "state": "string", "fits": "boolean", "source_active": "boolean", "source_known": "boolean"}
        rows = by_run(kept.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}), methods, *columns, *blank)
        packed.append(packing.pack_by_coverage(scoring.threshold(scoring.settle(rows.where("use_packing")), per_run), corpus.units).where("rank is not null").select("run_id", "unit_id", "rank"))
    if some := [m for m, f in methods.items() if not f[3]]:
        turns = F.explode(F.filter(F.array(*[F.when(good[m], F.struct(run(m).alias("run_id"), verdicts[m][0].alias("score"))) for m in some]), lambda x: x.isNotNull()))
        packed.append(packing.pack_by_score(assessed.where("tokens <= budget").select(turns.alias("x"), "unit_id", "tokens", "budget").select("x.*", "unit_id", "tokens", "budget", F.lit(None).alias("excluded"), F.lit(False).alias("use_packing"))).select("run_id", "unit_id", "rank"))
    out = packed[0] if len(packed) == 1 else packed[0].unionByName(packed[1])
    out = materialise(out.join(runs.select("run_id", "question_id", "method"), "run_id"), "picked")
    cited = corpus.units.join(out.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", "source_id", "source_location").join(corpus.sources.select("source_id", F.lit(True).alias("known")), "source_id", "left")
    return out.join(cited.select("unit_id", (F.col("known").isNotNull() & (F.col("source_location") != "")).alias("valid")), "unit_id").select("question_id", "method", "unit_id", "rank", "valid")
