"""Methods of the evaluation in one retrieval: what they share is worked out once, and each has the results it has alone."""

import threading

import pytest
from pyspark.sql import functions as F

from evigrain.operators import channels, evaluate, expansion, packing
from evigrain.plans import pipeline
from evigrain.plans import queries as Q
from evigrain.session import together
from evigrain.sources.corpus import held
from tests.test_packing import ASKED, ROWS, tables


@pytest.fixture
def sizes(monkeypatch):
    seen, real = {}, pipeline.materialise

    def noted(df, name):
        out = real(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(pipeline, "materialise", noted)
    return seen


def outcome(r, cut=""):
    plain = lambda df: sorted(str({k: v for k, v in x.asDict(True).items() if k != "run_id"}) for x in df.collect())
    of = (lambda df: df.where(F.col("run_id").endswith(cut))) if cut else (lambda df: df)
    return [plain(of(df)) for df in (r.selected(), r.excluded(), r.metrics(), r.contexts(), r.scored, r.candidates)]


def test_methods_share_their_candidates(spark, sizes):
    c, asked = held(tables(spark, ROWS)), spark.createDataFrame(ASKED, "question_id string, query string, budget int")
    every = pipeline.retrieve(asked, c, pipeline.METHODS)
    together_, alone = sizes.pop("candidates"), {}
    for m in ("main", "ablation_no_packing", "ablation_channels_only"):
        r = pipeline.retrieve(asked, c, {m: pipeline.METHODS[m]})
        alone[m] = sizes.pop("candidates")
        assert outcome(every, f"|{m}") == outcome(r)
    # five methods with the graph, one without; candidates of each question are written twice, not six times
    assert together_ == alone["main"] + alone["ablation_channels_only"]


def test_relation_names_as_bits_or_arrays(spark, monkeypatch):
    front = spark.createDataFrame([("r", f"u{i}", 0.5, [1, 3]) for i in range(4)], "run_id string, unit_id string, score double, facets array<int>")
    edges = spark.createDataFrame([(f"u{i % 4}", f"n{i % 5}", f"name {i:02}", 0.5) for i in range(62)], "anchor string, neighbour string, relation string, confidence double")
    names = expansion.relation_names(edges)
    assert len(names) == 62 == expansion.NAMES and names == sorted(names)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(expansion.contributions(front, edges, 1, names)) == rows(expansion.contributions(front, edges, 1))
    monkeypatch.setattr(expansion, "NAMES", 61)
    assert expansion.relation_names(edges) is None


def test_tasks_run_at_the_same_time(spark):
    meet = threading.Barrier(3, timeout=20)
    assert together(spark, *[lambda i=i: (meet.wait(), i)[1] for i in range(3)]) == [0, 1, 2]


def test_report_measures_all_methods_at_once(spark, monkeypatch):
    calls, real = [], evaluate.selected_metrics
    monkeypatch.setattr(evaluate, "selected_metrics", lambda *a: calls.append(1) or real(*a))
    r = Q.QUERIES["evaluation_report"](spark, "/root/testdata/sf0.001").first()
    assert len(calls) == 1  # one pass over units, not one for each of seven selections
    assert r.comparator in ("full_context", "local_rag", "graph_baseline") and r.citation_accuracy is not None


def test_stability_retrieves_at_the_same_time(spark, monkeypatch):
    meet, real = threading.Barrier(3, timeout=60), pipeline.retrieve
    monkeypatch.setattr(pipeline, "retrieve", lambda *a: (meet.wait(), real(*a))[1])
    rows = Q.QUERIES["stability"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 120 and all((r.unique_signatures, r.repetitions, r.stable) == (1, 3, True) for r in rows)


def test_selection_without_explanation_is_that_of_the_retrieval(spark, monkeypatch):
    c, asked = held(tables(spark, ROWS)), spark.createDataFrame(ASKED, "question_id string, query string, budget int")
    # every edge of a unit in a part of its own, and few rows, facets and pairs at a time
    monkeypatch.setattr(expansion.parted, "__defaults__", (1,))
    monkeypatch.setattr(channels, "FACETS", 2)
    monkeypatch.setattr(channels, "PAIRS", 3)
    r = pipeline.retrieve(asked, c, pipeline.METHODS)
    s = r.selected().join(r.runs.select("run_id", "method"), "run_id")
    want = {(x.question_id, x.method, x.unit_id, x["rank"], x.source_known and x.citation.source_location != "") for x in s.collect()}
    assert want and {(x.question_id, x.method, x.unit_id, x["rank"], x.valid) for x in pipeline.select(asked, c, pipeline.METHODS).collect()} == want


def test_report_hands_few_rows_to_the_methods(spark, monkeypatch):
    seen = {}

    def noted(real):
        def write(df, name):
            out = real(df, name)
            seen[name] = max(seen.get(name, 0), out.count())
            return out

        return write

    for m in (pipeline, packing):
        monkeypatch.setattr(m, "materialise", noted(m.materialise))
    Q.QUERIES["evaluation_report"](spark, "/root/testdata/sf0.001")
    # packing in the order of the score had all candidates of its methods, and so had the local baseline its pairs
    assert 0 < seen["pack-rest"] < seen["assessed"] / 5


def test_forms_at_hand_are_compared_in_place(spark, monkeypatch):
    monkeypatch.setattr(channels, "PAIRS", 50)
    monkeypatch.setattr(channels, "FACETS", 3)
    c = tables(spark, [(f"u{i:02}", "l", f"cache {'abc'[i % 3]}{i % 7}", "the cache evicts entries " * (i % 2), None, 1.0, None, None, i % 5 > 0, i) for i in range(40)])
    facets = spark.createDataFrame([("q", n, t.split()) for n, t in enumerate(["cache evict", "a1 b2 cache", "zz", "", "entry entries b1"])], "question_id string, facet_id int, forms array<string>")
    rows = lambda units: sorted(map(str, channels.overlap(facets, units, 5).collect()))
    assert rows(c.units) == rows(held(c).units) != []
