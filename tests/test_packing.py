"""Packing against plain loops, the expansion and the whole pipeline on small tables with odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain.operators.packing import pack_by_coverage, pack_in_order, takable
from evigrain.plans import pipeline
from evigrain.sources import corpus as C
from evigrain.operators.audit import marks


def greedy(rows, budget, facet_count):
    """One candidate at a time; everything is found anew at every step."""
    left, picked, used, ranks = list(rows), [], 0, {}
    seen_f, seen_c, seen_t = set(), set(), set()
    df = {}
    for r in rows:
        for t in r["matched"]:
            df[t] = df.get(t, 0) + 1
    weight = {t: round(math.log((1 + len(rows)) / (1 + d)) + 1, 10) for t, d in df.items()}
    while left:
        def utility(r):
            words = set(r["content"].split())
            similar = max((len(words & set(p["content"].split())) / len(words | set(p["content"].split())) for p in picked), default=0.0)
            gain = 0.010 * len(set(r["facets"]) - seen_f) / max(1, facet_count) + 0.018 * len(set(r["core_facets"]) - seen_c) + 0.004 * sum(weight[t] for t in set(r["matched"]) - seen_t)
            return round((r["score"] * (1 - 0.25 * similar) + gain) / (1 + 0.15 * r["tokens"] / budget), 9)

        best = min(left, key=lambda r: (-utility(r), -r["score"], r["tokens"], r["unit_id"]))
        left.remove(best)
        if used + best["tokens"] <= budget:
            used += best["tokens"]
            picked.append(best)
            ranks[best["unit_id"]] = (len(picked), used)
            seen_f |= set(best["facets"])
            seen_c |= set(best["core_facets"])
            seen_t |= set(best["matched"])
        else:
            ranks[best["unit_id"]] = (None, used + best["tokens"])
    return ranks


def test_packing_by_coverage_equals_plain_greedy(spark):
    rng, rows = random.Random(9), []
    for run in range(6):
        for i in range(40):
            facets = sorted(rng.sample(range(1, 5), rng.randint(0, 4)))
            rows.append(dict(run_id=f"r{run}", unit_id=f"u{i:02}", score=round(rng.random() / 10, 6), tokens=rng.randint(5, 90), facets=facets, core_facets=[f for f in facets if rng.random() < 0.3],
                             matched=sorted(rng.sample(["ant", "bee", "cat", "dog"], rng.randint(0, 4))), budget=120, facet_count=4, excluded=None, use_packing=True, content=" ".join(sorted({rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(5)}))))
        rows[-1] |= dict(facets=[], core_facets=[], matched=[])
    schema = "run_id string, unit_id string, score double, tokens int, facets array<int>, core_facets array<int>, matched array<string>, budget int, facet_count int, excluded string, use_packing boolean, content string"
    df = spark.createDataFrame(rows, schema)
    for run in range(6):
        mine = [r for r in rows if r["run_id"] == f"r{run}"]
        got = pack_by_coverage(df.where(F.col("run_id") == f"r{run}").drop("content"), df.where(F.col("run_id") == f"r{run}").select("unit_id", "content")).collect()
        assert {r.unit_id: (r.rank, r.would_use) for r in got} == greedy(mine, 120, 4)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_packing_in_order_takes_whatever_fits(spark, block):
    rng = random.Random(block)
    rows = [(f"r{i % 5}", f"u{i:03}", rng.randint(1, 60), 100 if i % 5 else 10, rng.random()) for i in range(200)] + [("none", "u", 500, 10, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, unit_id string, tokens int, budget int, s double")
    got = {(r.run_id, r.unit_id): r["rank"] for r in pack_in_order(df, "s", "unit_id", block=block).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        used = rank = 0
        for _, u, t, b, _ in sorted((r for r in rows if r[0] == run), key=lambda r: (r[4], r[1])):
            if used + t <= b:
                used, rank = used + t, rank + 1
                want[run, u] = rank
    assert got == want


GENES = "id string, locus_id string, label string, kind string, content string, summary string, source_id string, source_location string, community string, confidence double, valid_from string, valid_to string, metadata_json string, content_hash string, active boolean, created_at timestamp, ingest_seq bigint, unit_id string, score double"


def tables(spark, rows):
    full = [(i, loc, label, "K", text, None, src, "f:1", None, conf, None, end, meta, None, act, None, seq, "clash", 1.0) for i, loc, label, text, src, conf, end, meta, act, seq in rows]
    u = C.units(spark.createDataFrame(full, GENES))
    r = C.relations(spark.createDataFrame([("e1", " A ", "h", None, None, 1), ("e1", "a", "h", None, 0.5, 2), ("e2", "h", "h", "x", 1.0, 3), ("e3", None, "a", "x", 1.0, 4), ("e4", "h", "zz", "x", 1.0, 5), ("e5", "h", "b", "x", 1.0, 6)], "id string, source_id string, target_id string, relation string, confidence double, ingest_seq bigint"))
    s = C.sources(spark.createDataFrame([("s1", "p", "h" * 64, 1, None, False), ("s1", "p", "h" * 64, 1, None, True), ("s2", None, None, None, None, None)], "id string, path string, content_hash string, version int, created_at timestamp, active boolean"))
    e = spark.createDataFrame([(1, "e", "feedback.accepted", "a", 1.0), (2, "f", "mark.suppressed", "hid", 1.0), (3, "g", "gene.ingested", None, None)], "seq bigint, event_id string, event_type string, unit_id string, value double")
    return C.Corpus(u, r, s, marks(e))


ROWS = [
    ("a", "l1", "Cache policy", "the cache evicts old entries", "S1 ", 1.0, None, '{"status": "current"}', True, 1),
    ("a", "l1", "Cache policy", "the cache evicts old entries", "s1", 1.0, None, '{"status": "current"}', True, 9),
    ("old", "l1", "Cache", "the cache keeps entries", "s2", None, None, '{"status": "DEPRECATED"}', True, 2),
    ("past", "l2", "cache", "cache", None, 7.0, "2020-01-01", "{broken", True, 3),
    ("odd", "l3", None, None, "none", -1.0, "soon", None, None, 4),
    ("off", "l3", "cache", "cache cache", None, 1.0, None, None, False, 5),
    ("h", "l4", "Neighbour", "shard mirrors", None, 1.0, None, None, True, 6),
    ("b", "l5", "Second", "replica lags", None, 1.0, None, None, True, 7),
    ("hid", "l6", "cache two", "cache", None, 1.0, None, None, True, 8),
    (None, "l6", "cache", "cache", None, 1.0, None, None, True, 8),
]
ASKED = [("q1", "How does the cache evict entries", 100), ("q2", "list: cache -evicts", 1), ("q3", "", None), ("q4", None, 50), ("q5", "...", 50), ("q6", "previous cache versions", 500), ("q7", "zzz unknown", 60)]


def test_pipeline_on_odd_rows(spark):
    c = tables(spark, ROWS)
    r = pipeline.retrieve(spark.createDataFrame(ASKED, "question_id string, query string, budget int"), c)
    picked, out = {}, {}
    for x in r.selected().collect():
        picked.setdefault(x.question_id, []).append((x["rank"], x.unit_id))
    for x in r.excluded().collect():
        out.setdefault(x.question_id, {})[x.unit_id] = x.reason
    assert picked["q1"][0] == (1, "a") and out["q1"]["old"] == out["q1"]["past"] == "historical allele superseded" and out["q1"]["hid"] == "explicitly suppressed"
    assert out["q2"]["a"] == "repressor matched" and "q2" not in picked
    assert {u for _, u in picked["q6"]} >= {"a", "old", "past"} and "off" not in {u for _, u in picked["q6"]}
    # an empty query finds the first units; one that matches nothing finds none
    assert "q7" not in picked and "q7" not in out and {*dict((u, 1) for _, u in picked["q3"])} and "q4" in picked and "q5" in picked
    counts = {m.question_id: m for m in r.metrics().collect()}
    assert len(counts) == 7 and all(m.candidate_count == m.selected_count + m.excluded_count and m.context_tokens <= m.budget for m in counts.values()) and counts["q3"].budget == 1200
    seen = {x.unit_id: x for x in r.candidates.where("run_id = 'q1'").collect()}
    assert {"h", "b"} <= set(seen) and "graph:related_to:h1" in seen["h"].channels and "graph:x:h2" in seen["b"].channels and any(x.startswith("temporal:") for x in seen["a"].channels)


def test_empty_tables(spark):
    c = tables(spark, [])
    r = pipeline.retrieve(spark.createDataFrame(ASKED, "question_id string, query string, budget int"), c)
    assert r.selected().collect() == [] and r.metrics().count() == 7
    none = pipeline.retrieve(spark.createDataFrame([], "question_id string, query string, budget int"), tables(spark, ROWS))
    assert none.metrics().collect() == [] and none.contexts().collect() == []


def test_a_budget_below_one_is_an_error(spark):
    with pytest.raises(Exception, match="budget must be positive"):
        pipeline.planned(spark.createDataFrame([("q", "x", 0)], "question_id string, query string, budget int")).collect()


def test_what_may_be_taken_of_a_part_holds_what_is(spark):
    rng = random.Random(4)
    for _ in range(300):
        budget, tokens = rng.randint(1, 120), [rng.randint(1, 60) for _ in range(80)]
        used, picked = 0, set()
        for i, t in enumerate(tokens):
            if used + t <= budget:
                used += t
                picked.add(i)
        part = sorted(rng.sample(range(80), 40))
        kept = takable(np.array([tokens[i] for i in part]), budget)
        assert {part[i] for i in kept} >= picked & set(part) and len(kept) < 40
