import random

import numpy as np
import pytest

from evigrain.llm.leak import FMIndex, WaveletMatrix, leaked_passages, removal_spans, suffix_array, words

DOCS, ITEMS = "doc_id bigint, text string, question_id string, _k int", "question_id string, query string, first_word int"


def brute(docs, items, size=8):
    phrases = {}
    for q, t, *_ in items:
        w = words(t or "")
        for i in range(len(w) - size + 1):
            phrases.setdefault(tuple(w[i : i + size]), set()).add(q)
    out = set()
    for d, t, *_ in docs:
        w = words(t or "")
        for i in range(len(w) - size + 1):
            out |= {(d, q) for q in phrases.get(tuple(w[i : i + size]), ()) if q is not None}
    return out


def test_suffix_array_and_index_against_plain_search():
    rng = np.random.default_rng(2)
    for n, v in ((1, 1), (7, 1), (60, 2), (300, 4), (300, 60)):
        s = rng.integers(1, v + 1, n)
        t = np.append(s, 0)
        assert suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        fm = FMIndex(s)
        for m in (1, 2, 5):
            p = rng.integers(1, v + 2, (30, m))
            low, high = fm.search(p)
            for a, b, q in zip(low, high, p):
                places = [i for i in range(n - m + 1) if (s[i : i + m] == q).all()]
                assert sorted(fm.locate(np.arange(a, b)).tolist()) == places
    w = WaveletMatrix(s, 6)
    assert w.access(np.arange(len(s))).tolist() == s.tolist()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "in", *[f"v{i}" for i in range(40)]]
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 20]))), 0) for i in range(60)] + [("none", None, 0), (None, "a b c d e f g h i", 0), ("empty", "", 0)]
    docs = [(None, None, "x", 0), (1, "", "x", 0), (2, " ... ", "x", 0)]
    for i in range(3, 200):
        w = rng.choices(vocabulary, k=rng.choice([5, 30, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            q = words(rng.choice(items)[1] or "")
            w[rng.randrange(len(w)) : 0] = [x.upper() if rng.random() < 0.3 else x for x in q[rng.randint(0, 3) : rng.randint(5, 20)]]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w), "x", 0))
    return docs + docs[50:60], items


@pytest.mark.parametrize("block, shard", [(4_000_000, 400_000), (100, 400_000), (4_000_000, 50), (150, 120)])
def test_pairs_equal_brute_force_whatever_the_blocks(spark, block, shard):
    docs, items = corpus(block + shard)
    got = leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_words=block, shard_words=shard).collect()
    assert {(r.doc_id, r.question_id) for r in got} == brute(docs, items) and got
    text = {d[0]: d[1] for d in docs}
    asked = {q[0]: words(q[1] or "") for q in items}
    for r in got:
        span = words(text[r.doc_id][r.char_from : r.char_to])
        assert span == words(text[r.doc_id])[r.first_word : r.last_word + 1] and len(span) >= 8
        assert any(span[:8] == asked[r.question_id][i : i + 8] for i in range(len(asked[r.question_id])))


def test_removal_spans_merge_all_items(spark):
    rows = [(1, "a", 0, 10), (1, "b", 5, 20), (1, "c", 20, 25), (1, "d", 30, 40), (2, "a", 3, 9), (2, "a", 3, 9)]
    got = removal_spans(spark.createDataFrame(rows, "doc_id bigint, question_id string, char_from int, char_to int")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 25, 3), (1, 30, 40, 1), (2, 3, 9, 1)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_passages(none, some).collect() == []
    assert leaked_passages(spark.createDataFrame([(1, "a b c d e f g h", "x", 0)], DOCS), some).collect() == []


def test_a_dotted_capital_i_parts_no_word():
    assert words("İstanbul a") == ["i̇stanbul", "a"]
