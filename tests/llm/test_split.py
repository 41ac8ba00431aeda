import pytest

from evigrain.llm.split import LIMIT, OVERLAP, pieces


@pytest.mark.parametrize(
    "text, overlap",
    [
        (("word " * 200 + "z" * 120 + "\n") * 6, OVERLAP),  # the only white space is the cut itself
        (("あ" * 50 + "。" + "い" * 60 + "\n") * 30, 61),  # then punctuation
        ("a" * 4000, OVERLAP),
    ],
)
def test_every_piece_overlaps_its_predecessor(text, overlap):
    p = pieces(text)
    assert len(p) > 1 and {b - c for (_, b), (c, _) in zip(p, p[1:])} == {overlap}
    assert all(e - s <= LIMIT for s, e in p) and p[0][0] == 0 and p[-1][1] == len(text)


def test_pieces_cover_the_text_and_edits_stay_local():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "Sentence end. ", "line\n", "para\n\n", "längere Wörter, ", "日本語。"]) for _ in range(6000))
    p = pieces(text)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(c <= b for (_, b), (c, _) in zip(p, p[1:])) and all(b - a <= LIMIT and b > a for a, b in p)
    cut = {len(text) - b for _, b in p}
    changed = "abcd" + text
    again = {len(changed) - b for _, b in pieces(changed)}
    assert len(cut & again) > 0.9 * len(cut)


def test_records_of_all_kinds(spark):
    from evigrain.llm.split import split_oversized

    schema = "id string, source_location string, content string, ingest_seq bigint, piece string, gene_id int"
    rows = [("a", "f.md:3", "x " * 2000, 1, "p", 1), ("a", "f.md:3", "x " * 2000, 2, "p", 1), ("b", None, "y" * 1501, None, "p", 1), ("c", "", "z" * 1500, 1, "p", 1), ("d", "q", None, 1, "p", 1), ("e", "q", "", 1, "p", 1), (None, "q", "w" * 2000, 1, "p", 1)]
    got = split_oversized(spark.createDataFrame(rows, schema)).collect()
    assert {r.gene_id for r in got} == {"a", "b"} and all(len(r.piece) <= LIMIT for r in got)
    assert [r.piece_no for r in sorted(got, key=lambda r: r.piece_no) if r.gene_id == "a"] == list(range(1, 4))
    assert {r.piece_location for r in got if r.gene_id == "b"} == {""}
    assert split_oversized(spark.createDataFrame([], schema)).collect() == []
