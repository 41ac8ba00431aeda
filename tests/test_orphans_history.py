from collections import Counter
from datetime import datetime, timezone

import duckdb
import pytest

import __spark_entry__ as entry
from evigrain.operators.history import iso_instant, versions
from evigrain.operators.orphans import cascade, inherited, references

GENES = "id string, locus_id string, kind string, content string, source_id string, valid_from string, valid_to string, active boolean, created_at timestamp, ingest_seq bigint"
RELATIONS = "id string, source_id string, target_id string, created_at timestamp, ingest_seq bigint"
SOURCES = "id string, version int, created_at timestamp"


def day(n):
    return datetime(2024, 1, n, tzinfo=timezone.utc)


@pytest.mark.parametrize("query", ["p4_found", "p4_totals", "p4_cascade", "p5_found", "p5_history"])
def test_rows_equal_sql(spark, query):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("genes", "relations", "sources"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = Counter(con.sql(entry.oracle_sql()[query]).fetchall())
    got = entry.queries()[query](spark, folder)
    assert Counter(map(tuple, got.select(*con.sql(entry.oracle_sql()[query]).columns).collect())) == want and want


def test_reasons_and_inheritance(spark):
    gene = lambda i, src, active=True, d=5, seq=1: (i, "l", "k", "c", src, None, None, active, day(d), seq)
    genes = spark.createDataFrame([gene("a", " S1 "), gene("b", "s9"), gene("c", ""), gene("d", None, True), gene("d", None, False, seq=2), gene("e", "s2", d=3)], GENES)
    sources = spark.createDataFrame([("s1", 1, day(5)), ("s2", 1, day(4))], SOURCES)
    relations = spark.createDataFrame([("r1", "A", "b", day(5), 1), ("r2", "d", "x", day(6), 1), ("r3", "c", " ", day(4), 1)], RELATIONS)
    rows = {(r.ref_table, r.ref_field, r.record_id): (r.reason, r.inherited) for r in inherited(references(genes, relations, sources)).collect()}
    assert rows == {
        ("genes", "source_id", "a"): (None, False),
        ("genes", "source_id", "b"): ("absent", False),
        ("genes", "source_id", "e"): ("later", False),
        ("relations", "source_id", "r1"): (None, False),
        ("relations", "target_id", "r1"): (None, True),
        ("relations", "source_id", "r2"): ("deleted", False),
        ("relations", "target_id", "r2"): ("absent", False),
        ("relations", "source_id", "r3"): ("later", False),
    }


def test_the_cascade_goes_on_until_nothing_is_added(spark):
    chain = [("t", "f", f"r{i}", None, "t", f"r{i - 1}", None) for i in range(1, 7)] + [("t", "f", "r0", None, "t", "gone", "absent")]
    ring = [("t", "f", "a", None, "t", "b", None), ("t", "f", "b", None, "t", "a", None), ("t", "g", "a", None, "t", "r2", None)]
    refs = spark.createDataFrame(chain + ring, "ref_table string, ref_field string, record_id string, created_at timestamp, parent_table string, parent_id string, reason string")
    got = {r.record_id: r.level for r in cascade(refs).collect()}
    assert got == {f"r{i}": i for i in range(7)} | {"a": 3, "b": 4}
    assert cascade(refs.where("false")).collect() == []


def test_periods(spark):
    row = lambda i, kind, text, at, to=None, src=None: (i, "l", kind, text, src, at, to, True, day(1), 1)
    genes = spark.createDataFrame(
        [row("a", "K", "x  y", "2024-01-01"), row("b", " k ", "x y ", "2024-01-02T00:00:00", "2024-01-04"), row("c", "k", "z", "2024-01-05", src="s1"),
         row("d", "k", "new", "2024-01-04T21:00:00-03:00", src="s2"), row("e", "k", "q", "2024-02-30"), row("f", "k", "q", "n/a")], GENES
    )
    sources = spark.createDataFrame([("s1", 1, day(1)), ("s2", 2, day(1))], SOURCES)
    got = [(r.version, r.gene_id, r.gene_count, r.start.day, r.end and r.end.day) for r in versions(genes, sources).orderBy("version").collect()]
    assert got == [(1, "a", 2, 1, 4), (2, "d", 1, 5, None)]


def test_iso_spellings(spark):
    texts = ["2024-01-02", "2024-01-02 03:04", "2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05+0230", "2024-01-02T03", "2024-02-30", "2024-1-2", "tbd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(iso_instant("t").cast("string")).collect()]
    assert got == ["2024-01-02 00:00:00", "2024-01-02 03:04:00", "2024-01-02 03:04:05.5", "2024-01-02 00:34:05", "2024-01-02 03:00:00", None, None, None, None]
