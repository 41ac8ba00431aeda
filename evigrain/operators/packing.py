"""Packing of candidates under a token budget: by coverage (greedy, one run at a time) or in the order of a score."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import SHIFT
from evigrain.functions.text import render, term_list
from evigrain.operators import scoring
from evigrain.session import materialise

#: Candidates of a run that a round of packing in order looks at.
BLOCK = 256
#: Rows of a task that are looked at together for what can't be taken any more.
REACH = 300_000
_PACKED = "run_id string, unit_id string, rank int, utility double, new_facets int, new_core int, new_terms int, would_use long"


def _incidence(lists, columns: dict) -> np.ndarray:
    m = np.zeros((len(lists), len(columns)), bool)
    for i, values in enumerate(lists):
        m[i, [columns[v] for v in values if v in columns]] = True
    return m


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice by coverage: what fits is taken in the order of utility, and utilities are found anew after each.

    A rejection changes nothing, so everything that stands before the next candidate that fits is rejected at once.
    """
    pdf = pdf.sort_values("unit_id", ignore_index=True)
    n, budget, many = len(pdf), int(pdf["budget"].iloc[0]), int(pdf["facet_count"].iloc[0])
    score, cost = pdf["score"].to_numpy(float), pdf["tokens"].to_numpy(np.int64)
    columns = lambda c: {v: k for k, v in enumerate(sorted({x for xs in pdf[c] for x in xs}))}
    term_no = columns("matched")
    facets, core, matched = _incidence(pdf["facets"], columns("facets")), _incidence(pdf["core_facets"], columns("core_facets")), _incidence(pdf["matched"], term_no)
    df = matched.sum(axis=0)
    weight = np.array([round(math.log((1 + n) / (1 + d)) + 1.0 + SHIFT, 10) for d in df])
    sizes = np.array([len(ws) for ws in pdf["terms"]], np.int64)
    words, flat = np.unique(np.concatenate([np.asarray(ws, np.int64) for ws in pdf["terms"]]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    similar = np.zeros(n)
    got_f, got_c, got_t = (np.zeros(m.shape[1], bool) for m in (facets, core, matched))
    left, used, rank, rows = np.ones(n, bool), 0, 0, []
    while left.any():
        nf, nc, nt = (facets & ~got_f).sum(axis=1), (core & ~got_c).sum(axis=1), matched & ~got_t
        gain = fixed.FACET_GAIN * nf / max(1, many) + fixed.CORE_GAIN * nc + fixed.LEXICAL_GAIN * (nt @ weight if len(weight) else np.zeros(n))
        utility = np.round((score * (1.0 - fixed.REDUNDANCY * similar) + gain) / (1.0 + fixed.LENGTH_COST * cost / max(1, budget)) + SHIFT, 10)
        order = np.lexsort((np.arange(n), cost, -score, -utility))
        order = order[left[order]]
        fits = used + cost[order] <= budget
        any_fits, at = bool(fits.any()), int(fits.argmax())
        turn = order[: at + 1] if any_fits else order
        left[turn] = False
        ranks = np.zeros(len(turn), np.int64)
        if any_fits:
            rank += 1
            ranks[-1] = rank
        rows.append((turn, ranks, utility[turn], nf[turn], nc[turn], nt[turn].sum(axis=1), used + cost[turn]))
        if any_fits:
            i = turn[-1]
            used += int(cost[i])
            got_f |= facets[i]
            got_c |= core[i]
            got_t |= matched[i]
            mine = np.zeros(len(words), bool)
            mine[flat[owner == i]] = True
            both = np.bincount(owner[mine[flat]], minlength=n) if len(flat) else np.zeros(n)
            either = sizes + sizes[i] - both
            similar = np.maximum(similar, np.divide(both, either, out=np.zeros(n), where=either > 0))
    turn, *values = (np.concatenate(x) for x in zip(*rows))
    out = pd.DataFrame(dict(zip([x.split()[0] for x in _PACKED.split(", ")], [key[0], pdf["unit_id"].to_numpy()[turn], *values])))
    out["rank"] = out["rank"].astype("Int32").mask(out["rank"] == 0)
    return out


def pack_by_coverage(expressed: DataFrame, units: DataFrame) -> DataFrame:
    """Selected (with rank) and rejected candidates of the runs that pack by coverage.

    The choice is sequential within a run, so runs are what is parallel; a run has its channel candidates (50 for each
    of 3 channels and 8 facets at most) and the expanded ones that passed the threshold. Ties go to the higher score,
    the cheaper unit, the smaller id. The tokens of a context are the sum of those of its units, since the blank line between them has none.
    """
    c = expressed.where("excluded is null and use_packing").select("run_id", "unit_id", "score", "tokens", "facets", "core_facets", "matched", "budget", "facet_count")
    # the words of a content as hashes: redundancy only asks which are shared
    terms = units.select("unit_id", F.transform(term_list("content"), lambda t: F.xxhash64(t)).alias("terms"))
    c = c.join(terms, "unit_id")
    return c.groupBy("run_id").applyInPandas(_pack, _PACKED)


def takable(tokens: np.ndarray, budget: int) -> list[int]:
    """Places, in a part of a list in its order, of what packing in order may still take.

    A unit is taken only if every earlier one that costs as much or less was taken too, as room only shrinks. So what costs t
    has no chance behind others of t or less that leave no t of the budget; that holds in any part of the list.
    """
    kept, costs, most, at = [], [], budget, 0
    while at < len(tokens):
        near = tokens[at:] <= most
        step = int(near.argmax())
        if not near[step]:
            break
        at += step
        kept.append(at)
        insort(costs, int(tokens[at]))
        used, most = 0, None
        for c in costs:
            if used + 2 * c > budget:
                most = min(c - 1, budget - used)
                break
            used += c
        most = budget - used if most is None else most
        at += 1
    return kept


def _reach(batches):
    """Of rows in the order (score down, tokens, unit_id) of each run what may be taken, block by block."""

    def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some).combine_chunks()
        run = t["run_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        tokens, budget, score = (t[c].to_numpy() for c in ("tokens", "budget", "score"))
        order = np.lexsort((tokens, -score, run))
        run, tokens, budget, score = (x[order] for x in (run, tokens, budget, score))
        ends = np.flatnonzero(np.diff(run, append=-1)) + 1
        kept = np.concatenate([b + np.array(takable(tokens[b:e], int(budget[b])), np.int64) for b, e in zip([0, *ends[:-1]], ends)])
        # ids aren't compared here: of those that are equal in all else, all stay or none
        same = np.cumsum(np.concatenate([[False], (np.diff(run) != 0) | (np.diff(score) != 0) | (np.diff(tokens) != 0)]))
        return t.take(pa.array(order[np.isin(same, same[kept])])).combine_chunks().to_batches()

    held, n = [], 0
    for b in batches:
        held, n = [*held, b] if b.num_rows else held, n + b.num_rows
        if n >= REACH:
            yield from block(held)
            held, n = [], 0
    if held:
        yield from block(held)


def within_reach(rows: DataFrame) -> DataFrame:
    """Rows (run_id, unit_id, score, tokens, budget) that packing in the order of score, tokens and id may take: a few for each run and task."""
    return rows.where("tokens <= budget").select("run_id", "unit_id", "score", F.col("tokens").cast("bigint").alias("tokens"), F.col("budget").cast("bigint").alias("budget")).mapInArrow(_reach, "run_id string, unit_id string, score double, tokens bigint, budget bigint")


def pack_in_order(ranked: DataFrame, *order, block: int = BLOCK) -> DataFrame:
    """(run_id, unit_id, rank, would_use): every unit that fits when its turn comes, in the given order.

    ``ranked`` has run_id, unit_id, tokens and budget. However long a run's list is, no task holds more than a block of it: a round takes
    the first units that still fit, packs them, and goes on behind the last one with what is left of the budget.
    Each round selects at least one unit for every run that is still open, so there are no more rounds than units in a context.
    """
    place = [F.struct(*order)] if len(order) > 1 else list(order)
    rest = materialise(ranked.where("tokens <= budget").select("run_id", "unit_id", "tokens", F.col("budget").cast("bigint").alias("room"), "budget", place[0].alias("place"), F.lit(0).alias("taken")), "pack-rest")
    done = []
    w = Window.partitionBy("run_id").orderBy("place")
    while not rest.isEmpty():
        head = rest.withColumn("at", F.row_number().over(w)).where(F.col("at") <= block)
        groups = head.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("place", "unit_id", "tokens"))).alias("x"), F.first("room").alias("room"), F.first("budget").alias("budget"), F.first("taken").alias("taken"))
        start = F.struct(F.col("room").alias("room"), F.col("taken").alias("rank"), F.array().cast("array<struct<unit_id:string,rank:int,would_use:bigint>>").alias("got"))

        def step(acc, u):
            fits = u.tokens <= acc.room
            row = F.struct(u.unit_id.alias("unit_id"), (acc.rank + 1).alias("rank"), (F.col("budget") - acc.room + u.tokens).cast("bigint").alias("would_use"))
            return F.struct(
                F.when(fits, acc.room - u.tokens).otherwise(acc.room).alias("room"), F.when(fits, acc.rank + 1).otherwise(acc.rank).alias("rank"),
                F.when(fits, F.concat(acc.got, F.array(row))).otherwise(acc.got).alias("got"),
            )

        packed = materialise(groups.select("run_id", F.element_at("x", -1).place.alias("last"), F.aggregate("x", start, step).alias("a")), "pack-round")
        done.append(packed.select("run_id", F.explode("a.got").alias("g")).select("run_id", "g.unit_id", "g.rank", "g.would_use"))
        state = packed.select("run_id", "last", F.col("a.room").alias("room"), F.col("a.rank").alias("taken"))
        rest = materialise(rest.drop("room", "taken").join(state, "run_id").where("place > last and tokens <= room").select("run_id", "unit_id", "tokens", "room", "budget", "place", "taken"), "pack-rest")
    if not done:
        return ranked.sparkSession.createDataFrame([], "run_id string, unit_id string, rank int, would_use bigint")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _turn() -> list:
    return [(-F.col("score")).alias("s"), F.col("tokens").alias("t"), F.col("unit_id").alias("u")]


def _as_packed(df: DataFrame) -> DataFrame:
    """Rows of packing in order with the columns of packing by coverage."""
    return df.select("run_id", "unit_id", "rank", *[F.lit(None).cast(t).alias(c) for c, t in (("utility", "double"), ("new_facets", "int"), ("new_core", "int"), ("new_terms", "int"))], "would_use")


def pack_by_score(expressed: DataFrame) -> DataFrame:
    """Selected candidates of the runs that pack in the order of their score."""
    return _as_packed(pack_in_order(within_reach(expressed.where("excluded is null and not use_packing")), *_turn()))


def lost_by_score(expressed: DataFrame, ordered: DataFrame) -> DataFrame:
    """What didn't fit of the runs that pack in the order of their score, ``ordered`` being what did: nearly all candidates of these runs."""
    plain = expressed.where("excluded is null and not use_packing")
    # what was selected before its turn is what a rejected unit would have come on top of
    rows = plain.select("run_id", "unit_id", "tokens", F.struct(*_turn()).alias("place"))
    before = rows.join(ordered.select("run_id", "unit_id"), ["run_id", "unit_id"], "left_semi").select("run_id", F.col("place").alias("p"), F.col("tokens").alias("used"))
    out = rows.join(ordered.select("run_id", "unit_id"), ["run_id", "unit_id"], "left_anti").join(before, "run_id", "left")
    lost = out.groupBy("run_id", "unit_id", "tokens").agg(F.sum(F.when(F.col("p") < F.col("place"), F.col("used")).otherwise(0)).alias("used")).select(
        "run_id", "unit_id", F.lit(None).cast("int").alias("rank"), (F.col("used") + F.col("tokens")).cast("bigint").alias("would_use")
    )
    return _as_packed(lost)


def contexts(scored: DataFrame, packed: DataFrame, units: DataFrame) -> DataFrame:
    """(run_id, context, context_tokens, selected): the rendered selection of each run, a blank line between units."""
    s = packed.where("rank is not null").join(scored.select("run_id", "unit_id", "tokens"), ["run_id", "unit_id"]).join(units.select("unit_id", render().alias("rendered")), "unit_id")
    rows = F.sort_array(F.collect_list(F.struct("rank", "unit_id", "rendered")))
    return s.groupBy("run_id").agg(rows.alias("x"), F.sum("tokens").alias("context_tokens")).select(
        "run_id", F.array_join("x.rendered", "\n\n").alias("context"), "context_tokens", F.col("x.unit_id").alias("selected")
    )


def selected_payload(scored: DataFrame, packed: DataFrame, candidates: DataFrame, runs: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """Each selected unit with rank, score, tokens, facets, matched terms, citation and reasons."""
    how = F.when(F.col("use_packing"), F.concat(F.lit("coverage-splice=facets:"), "new_facets", F.lit(",core:"), "new_core", F.lit(",terms:"), "new_terms")).otherwise(F.lit("score-order"))
    cite = F.struct("source_id", "source_location", F.coalesce("source_hash", F.lit("")).alias("source_hash"), "source_version", "source_active", "confidence")
    s = packed.where("rank is not null").join(scored, ["run_id", "unit_id"]).join(candidates.select("run_id", "unit_id", "channels"), ["run_id", "unit_id"]).join(runs.select("run_id", "task"), "run_id")
    s = s.join(units.select("unit_id", "subject_id", "label", "source_id", "source_location", "confidence"), "unit_id")
    s = s.join(sources.select("source_id", F.col("content_hash").alias("source_hash"), F.col("version").alias("source_version")), "source_id", "left")
    return scoring.reasons(s).select(
        "run_id", "question_id", "rank", "unit_id", "subject_id", "label", "score", F.col("tokens").alias("estimated_tokens"), F.col("facets").alias("facet_ids"), F.col("core_facets").alias("core_facet_ids"),
        F.col("matched").alias("matched_terms"), cite.alias("citation"), F.concat("reasons", F.array(how)).alias("reasons"), "source_known",
    )


def excluded_payload(scored: DataFrame, packed: DataFrame) -> DataFrame:
    """Each excluded candidate with its reason and what belongs to it."""
    p = packed.where("rank is null").select("run_id", "unit_id", F.lit("token budget").alias("lost"), "would_use")
    out = scored.join(p, ["run_id", "unit_id"], "left").withColumn("reason", F.coalesce("excluded", "lost")).where("reason is not null")
    low = F.col("reason") == "expression threshold"
    return out.select(
        "run_id", "question_id", "unit_id", "reason", F.when(F.col("reason") == "repressor matched", F.col("barred")).alias("matched"),
        F.when(low, F.col("score")).alias("score"), F.when(low, F.col("floor")).alias("threshold"), F.when(F.col("reason") == "token budget", F.col("tokens")).alias("estimated_tokens"), F.col("would_use").alias("would_use_tokens"),
    )
