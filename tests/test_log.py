"""Linking, streaming and evaluation on small rows."""

import pytest
from pyspark.sql import functions as F

from evigrain.operators import audit, evaluate
from evigrain.streaming import log


def events(spark, n, start=1):
    return spark.range(start, start + n).select(F.col("id").alias("seq"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("feedback.accepted").alias("event_type"), F.concat(F.lit("u"), F.col("id") % 3).alias("unit_id"), F.col("id").cast("double").alias("value"), F.lit(None).cast("timestamp").alias("created_at"))


def test_the_value_before_is_found_across_buckets(spark):
    rows = [(i, f"v{i}") for i in (0, 1, 9, 10, 35, 36, 90)]
    got = audit.previous(spark.createDataFrame(rows, "n bigint, v string").repartition(3), "n", "v", bucket=10).collect()
    assert {r.v: r.previous for r in got} == {"v0": None, "v1": "v0", "v9": "v1", "v10": "v9", "v35": "v10", "v36": "v35", "v90": "v36"}


def test_linking_in_parts_equals_linking_at_once(spark):
    whole = {r.seq: r.event_hash for r in audit.link(events(spark, 20).repartition(4)).collect()}
    head = audit.link(events(spark, 8)).orderBy(F.desc("seq")).first().event_hash
    parts = {r.seq: r.event_hash for r in audit.link(events(spark, 12, 9), head).collect()}
    assert parts == {s: h for s, h in whole.items() if s > 8}
    assert audit.verify(audit.link(events(spark, 0))).collect() == []


def test_a_stream_of_events_makes_the_same_log(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    assert log.read_log(spark, out) is None
    for k in range(3):
        events(spark, 5, 1 + 5 * k).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, 1).schema).parquet(source)
        q = log.link_stream(stream, out, str(tmp_path / "state"))
        q.awaitTermination()
        q.stop()
    got = log.read_log(spark, out)
    assert {r.seq: r.event_hash for r in got.collect()} == {r.seq: r.event_hash for r in audit.link(events(spark, 15)).collect()}
    assert audit.verify(got).isEmpty()
    marks = log.marks_stream(spark.readStream.schema(events(spark, 1).schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("marks").trigger(availableNow=True).start()
    marks.awaitTermination()
    assert {tuple(r) for r in spark.table("marks").collect()} == {tuple(r) for r in audit.marks(events(spark, 15)).collect()}


def test_a_fingerprint_tells_rows_apart_not_their_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    one = lambda r: audit.fingerprint(spark.createDataFrame(r, "x int, y string")).first()
    assert one(rows) == one(rows[::-1]) != one(rows[:-1]) and one(rows) != one([(1, "a"), (2, ""), (2, None), (3, "")]) and one([]).rows == 0


def test_metrics_of_edge_cases(spark):
    q = spark.createDataFrame([("full", ["a", "b", "a", ""]), ("half", ["a", "x"]), ("none", []), ("null", None), ("miss", ["z"])], "question_id string, expected_gene_ids array<string>")
    u = spark.createDataFrame([(x, "l", "c", "p", "s", 1.0) for x in "abc"], "unit_id string, label string, content string, source_location string, source_id string, confidence double")
    picked = spark.createDataFrame([("full", "b", 1), ("full", "a", 2), ("half", "c", 1), ("half", "a", 2), ("null", "a", 1), ("miss", "a", 1)], "question_id string, unit_id string, rank int")
    valid = picked.select("question_id", "unit_id", (F.col("unit_id") != "c").alias("valid"))
    m = {r.question_id: r for r in evaluate.selected_metrics(q, picked, u, valid, F.lit("m")).collect()}
    assert (m["full"].recall, m["full"].precision, m["full"].mrr, m["full"].ndcg, m["full"].citation_accuracy) == (1, 1, 1, 1, 1)
    assert (m["half"].recall, m["half"].precision, m["half"].f1, m["half"].mrr, m["half"].citation_accuracy) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert (m["none"].recall, m["none"].precision, m["none"].ndcg, m["none"].context_tokens) == (1, 1, 1, 0)
    assert (m["null"].recall, m["null"].precision, m["null"].ndcg) == (1, 0, 1) and (m["miss"].recall, m["miss"].ndcg, m["miss"].f1) == (0, 0, 0)


def test_ranks_over_all_rows(spark):
    rows = [(f"k{i:03}",) for i in range(50)]
    got = evaluate.ranks(spark.createDataFrame(rows, "k string").repartition(5), "k", prefix=3).collect()
    assert {r.k: r["rank"] for r in got} == {k: i for i, (k,) in enumerate(rows, 1)}


def test_bootstrap_and_suite(spark):
    d = spark.createDataFrame([(f"q{i}", float(i % 2)) for i in range(20)], "question_id string, v double")
    b = evaluate.bootstrap(d, "v", rounds=500).first()
    assert b.mean == 0.5 and 0.2 < b.ci95_low < 0.5 < b.ci95_high < 0.8
    assert tuple(evaluate.bootstrap(d.where("false"), "v", rounds=10).first()) == (0.0, 0.0, 0.0, 10)
    q = spark.createDataFrame([("a", "x", ["u"]), ("b", "x", ["gone"]), ("c", "", ["u"]), ("d", "y", [])], "question_id string, query string, expected_gene_ids array<string>")
    u = spark.createDataFrame([("u", True)], "unit_id string, active boolean")
    assert sorted((r.error, r.question_id) for r in evaluate.suite_errors(q, u).collect()) == [("empty id or query", "c"), ("nothing expected", "d"), ("repeated query", "a"), ("unknown unit", "b")]
    declared = {"expected_questions": 5, "category_counts": {"x": 3}, "stability": {"question_ids": ["a", "zz"], "repetitions": 1}, "locked_gates": {"token_savings": 0.5}}
    more = [r.error for r in evaluate.suite_errors(q.withColumn("category", F.lit("x")), u, declared).collect()]
    assert {"number of questions", "category count", "gates", "unknown stability question", "too few repetitions"} <= set(more)


def test_costs_by_a_tokenizer(spark, tmp_path):
    import base64

    from evigrain.functions.costs import tokenizer
    from evigrain.functions.text import token_estimate

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abab"]
    (tmp_path / "v.tiktoken").write_text("\n".join(f"{base64.b64encode(b).decode()} {i}" for i, b in enumerate(ranks)))
    df = spark.createDataFrame([("abab ab",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokenizer(str(tmp_path / "v.tiktoken"))(F.col("t"))).collect()] == [3, 0, 0]
    assert tokenizer(str(tmp_path / "none")) is token_estimate
