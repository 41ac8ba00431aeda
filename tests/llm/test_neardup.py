import itertools
import random

import numpy as np
import pytest

from evigrain.llm import neardup
from evigrain.llm.neardup import similar_records, words

SCHEMA = "id string, locus_id string, content string, c1 int, key int"


def brute(rows):
    """Every pair of ids of different subjects, compared in full."""
    w = {i: (l.strip().lower(), words(t)) for i, l, t, *_ in rows if i is not None and l and t and words(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(w), 2) if w[a][0] != w[b][0] and 5 * len(w[a][1] & w[b][1]) >= 4 * len(w[a][1] | w[b][1])}


def copies(n, seed):
    """Texts of all lengths with edited copies; few common words, so that chunks coincide."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(2000)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = list(words(rng.choice(rows)[2]))
            for _ in range(rng.randint(0, max(1, len(base) // 5))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        else:
            base = rng.choices(vocabulary[:60], k=rng.choice([1, 2, 3, 5, 9, 20])) + rng.choices(vocabulary, k=rng.choice([0, 1, 4, 10, 40, 300]))
        rng.shuffle(base)
        rows.append((f"g{i:04}", f"l{i % 7}", " ".join(base), i, i))
    return rows


@pytest.mark.parametrize("hot, block", [(1, 4096), (1, 3), (4, 2), (64, 4096)])
def test_no_pair_is_missed_however_few_keys_are_hot(spark, monkeypatch, hot, block):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = copies(500, hot)
    want = brute(rows)
    got = [tuple(r) for r in similar_records(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_nulls_ties_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [("a", " L1", "One two THREE", 1, 1), ("a", " L1", "One two THREE", 1, 1), ("b", "l2", "three, two; one!", 1, 1), ("c", "l1 ", "one two three", 1, 1), ("d", None, "one two three", 1, 1),
            (None, "l3", "one two three", 1, 1), ("e", "l4", None, 1, 1), ("f", "l5", "", 1, 1), ("g", "l6", " - . ", 1, 1), ("h", "l7", long, 1, 1), ("i", "l8", long + " more", 1, 1)]
    got = sorted(tuple(r) for r in similar_records(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("a", "b"), ("b", "c"), ("h", "i")]
    assert similar_records(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dotted_capital_i_is_one_word():
    assert words("İstanbul") == {"i̇stanbul"}


def test_chunks_and_bands_keep_the_promise():
    """A pair within the bound meets in as many chunks as there are spare ones."""
    rng = np.random.default_rng(3)
    for t in range(0, 200):
        k = neardup.chunks(t)
        for _ in range(20):
            small = int(rng.integers(0, t // 2 + 1))
            large = int(rng.integers(small, t - small + 1))
            a, b = np.bincount(rng.integers(0, k, small), minlength=k), np.bincount(rng.integers(0, k, large), minlength=k)
            assert ((a == 0) & (b <= 1)).sum() >= neardup.spare(t)


def test_a_batch_may_end_anywhere():
    """Runs of equal keys that go on over batches are judged as one."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = np.sort(rng.choice(np.array([2, 3, 8, 9, 20, 21, 22]), 400)).astype(np.int64)
    d = ((np.int64(50) << neardup.DIGEST) + rng.integers(0, 1 << 10, 400)).astype(np.int64)

    def result(step):
        parts = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(d[i : i + step])], names=["key", "d"]) for i in range(0, 400, step)]
        return {tuple(r.values()) for b in neardup._buckets(None)(parts) for r in b.to_pylist()}

    assert result(400) == result(7) == result(1)
