import pytest

from evigrain.llm.encode import encode_ids, encoding, vocabulary

KINDS = [
    None, "", " ", "\n\n\t  \n", "plain words, and 12,345 numbers; don't we'll", "a" * 300, " " * 300 + "x", "x" + "\n" * 200 + "y",
    "<|endoftext|> is plain text " * 8, "def f(x):\r\n\treturn {'k': [1, 2]}\r\n" * 6, "| a | b |\n|---|---|\n" * 9, "Ünïcödé é é ﬁ ‍⁠ " * 9,
    "データベースの障害対応について。" * 9, "Проверка журнала, затем перезапуск. " * 6, "👩🏽‍💻🇧🇷" * 40, "1234567890" * 30, "....!!!???" * 30, "a b　c d " * 30,
]


@pytest.mark.parametrize("chunk, overlap", [(16, 8), (40, 20), (64, 5)])
def test_chunks_give_the_ids_of_the_whole(spark, chunk, overlap):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = KINDS + real
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode_ids(docs, chunk=chunk, overlap=overlap).collect()}
    enc = encoding(vocabulary())
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert sum(len(t or "") > chunk for t in texts) > 90


def test_null_and_repeated_keys_keep_their_rows(spark):
    texts = ["a b c " * 40, "d e f " * 40, "short", None]
    rows = [(None, t, 1) for t in texts] + [(7, t, 1) for t in texts]
    got = encode_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3), chunk=64, overlap=20).collect()
    enc = encoding(vocabulary())
    want = [enc.encode_ordinary(t) if t else [] for t in texts]
    for key in (None, 7):
        assert sorted(r.ids for r in got if r.doc_id == key) == sorted(want)
    assert encode_ids(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_decoding_gives_the_text_back():
    from evigrain.llm.encode import decode_ids

    for t in KINDS:
        if t:
            assert decode_ids(encoding(vocabulary()).encode_ordinary(t)) == t
