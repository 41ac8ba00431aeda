from collections import Counter

import __spark_entry__ as entry
from evigrain.llm.neardup import similar_groups, similar_records
from evigrain.operators.components import components


def reference(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    links = Counter(x for p in pairs for x in p)
    return {i: (find(i) if links[i] else None, links[i]) for i in ids}


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("p", "p")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | dict.fromkeys("xyz", "x")


def test_groups_are_those_of_the_pairs(spark):
    words = [f"w{i}" for i in range(30)]
    text = lambda i: " ".join(words[i : i + 12])
    rows = [(f"g{i}", f"l{i % 5}", text(i)) for i in range(8)]  # a chain of near copies
    rows += [("h0", "m", "same words here"), ("h1", "m", "here same words"), ("h2", "n", "Same words, here"), ("i0", "q", "twin text"), ("i1", "q", "twin text")]
    rows += [("j0", "q", "  "), ("j1", "q", None), ("k0", None, "same words here"), ("g0", " L0 ", text(0))]
    genes = spark.createDataFrame(rows, "id string, locus_id string, content string")
    pairs = [tuple(r) for r in similar_records(genes).collect()]
    got = {r.gene_id: r for r in similar_groups(genes).collect()}
    assert {i: (r.group_id, r.links) for i, r in got.items()} == reference({r[0] for r in rows}, pairs)
    assert {got[f"g{i}"].group_id for i in range(8)} == {"g0"} and got["h1"].links == 1 and got["h2"].links == 2
    assert [got[i].class_id for i in ("h1", "k0", "i1", "j0", "j1")] == ["h0", "h0", "i0", None, None]


def test_groups_of_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in entry.queries()["p2_found"](spark, folder).collect()]
    rows = entry.queries()["p2_groups"](spark, folder).collect()
    assert {r.gene_id: (r.group_id, r.links) for r in rows} == reference({r.gene_id for r in rows}, pairs) and pairs
    assert len(rows) == spark.read.parquet(f"{folder}/genes.parquet").select("id").distinct().count()
