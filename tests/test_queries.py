"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from evigrain.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: Queries that run the whole pipeline once more to look at one stage; those that stand for the others are below.
PIPELINE = {
    "current_version", "superseded", "confidence_coverage", "task_boost", "core_match", "term_weights", "pack_coverage", "metrics_prf", "mrr", "ndcg", "summary_grouping_sets", "paired_deltas", "feedback_events", "expand_h1",
    "facet_inherit", "frontier_join", "protected_top2", "rrf", "stability", "bootstrap", "suppressor_terms", "expand_h2",
}


def rows(columns, values):
    def plain(v):
        return f"{v:.8g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "genes loci sources relations questions documents events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - PIPELINE))
def test_rows_equal_sql(spark, db, name):
    got = registry.queries()[name](spark, FOLDER)
    want = db.sql(registry.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert "unit_id" in first.columns and first.count() > 0
