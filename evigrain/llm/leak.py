"""Evaluation passages inside a training corpus, by an FM-index per corpus shard (problem 7).

All words of a shard's documents are strung together, a separator behind each, and indexed: suffix array by prefix
doubling of what is not yet in order, Burrows-Wheeler transform, wavelet matrix for ranks, a sample of suffix positions. Every
phrase of the test items is searched backwards through the ranks, all phrases at once; occurrences are located by
walking to the next sampled position, and overlapping ones merged into spans. A shard is a part of a scan partition, so the
corpus isn't shuffled. The phrases are the only thing sent to all executors, in blocks whose size is bounded.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrain.sources.tables import table

#: Consecutive words that make a passage.
PASSAGE = 8
#: One suffix position in so many is kept.
SAMPLE = 8
#: Words of test items that are searched for at a time: a block is an integer for each, some 20 MB. Indexed words of a shard.
BLOCK_WORDS, SHARD_WORDS = 4_000_000, 400_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased maximal runs of letters and digits, in order."""
    if "\u0130" in text:  # its small form is two characters, one of them no letter
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with cumulative counts per bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros(len(sym), np.int64)
        at = at.astype(np.int64)
        for k in range(self.bits):
            one = ((sym >> (self.bits - 1 - k)) & 1).astype(bool)
            r = self.ranks[k]
            ra, rl = r[at].astype(np.int64), r[low].astype(np.int64)
            at = np.where(one, self.zeros[k] + ra, at - ra)
            low = np.where(one, self.zeros[k] + rl, low - rl)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given positions."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.bits):
            r = self.ranks[k]
            one = r[at + 1] > r[at]
            ra = r[at].astype(np.int64)
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + ra, at - ra)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of numbers from 0: three symbols first, then prefix doubling of ties only."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    width = int(rank.max()).bit_length()
    step = max(1, min(3, 63 // width))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << width
        key[: n - k if n > k else 0] |= rank[k:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first  # a suffix has the place of the first of its group
    while True:
        size = np.diff(np.append(np.flatnonzero(begin), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places that are not settled
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        o = np.lexsort((after, rank[at]))
        at, group, after = at[o], rank[at][o], after[o]
        order[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        begin[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class FMIndex:
    """Count and locate phrases in a sequence of symbols >= 1; 0 ends it."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.append(np.asarray(seq, np.int64), 0)
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.top = int(seq.max()) + 1
        self.first = np.zeros(self.top + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=self.top), out=self.first[1:])
        self.wave = WaveletMatrix(bwt, max(1, int(self.top - 1).bit_length()))
        kept = sa % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases of one length, searched backwards together."""
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            ok = (c < self.top) & (low < high)
            c = np.where(ok, c, 0)
            low = np.where(ok, self.first[c] + self.wave.rank(c, low), 0)
            high = np.where(ok, self.first[c] + self.wave.rank(c, high), 0)
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        out, at, step = np.full(len(rows), -1, np.int64), rows.astype(np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked[at + 1] > self.marked[at]
            out[open_[hit]] = self.sampled[self.marked[at[hit]]] + step
            open_, at = open_[~hit], at[~hit]
            if len(at):
                c = self.wave.access(at)
                at = self.first[c] + self.wave.rank(c, at)
            step += 1
        return out


class Phrases:
    """A block of test items as numbers: the words, the distinct phrases of one length, and the items of each."""

    def __init__(self, items: list[tuple[str, list[str]]], size: int):
        self.size, self.ids = size, [i for i, _ in items]
        code, vocab = pd.factorize(np.array([w for _, ws in items for w in ws], dtype=object))
        self.vocab = list(vocab)
        n = np.array([len(ws) for _, ws in items], np.int64)
        each = np.maximum(n - size + 1, 0)
        base = np.repeat(np.cumsum(n) - n, each) + (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
        all_ = code[base[:, None] + np.arange(size)] if len(base) else np.zeros((0, size), np.int64)
        self.phrases, which = np.unique(all_, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.repeat(np.arange(len(items)), each)], 1), axis=0)
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))
        self.owner = pairs[:, 1]


class Shard:
    """Documents that are indexed together."""

    def __init__(self):
        self.keys, self.texts, self.words, self.starts = [], [], [], []

    def add(self, key, text: str) -> None:
        self.starts.append(len(self.words))
        self.keys.append(key)
        self.texts.append(text)
        self.words += words(text)
        self.words.append("")

    def search(self, p: Phrases) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, last word) of each merged span."""
        code, vocab = pd.factorize(np.array(self.words, dtype=object))
        number = {w: i for i, w in enumerate(vocab)}
        known = np.array([number.get(w, -1) for w in p.vocab], np.int64)
        phrases = known[p.phrases]
        mine = np.flatnonzero((phrases >= 0).all(axis=1))
        if not len(mine):
            return []
        fm = FMIndex(code + 1)
        low, high = fm.search(phrases[mine] + 1)
        found = np.flatnonzero(high > low)
        n = (high - low)[found]
        at = fm.locate(np.repeat(low[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        which = np.repeat(mine[found], n)
        doc = np.searchsorted(np.array(self.starts), at, side="right") - 1
        place = at - np.array(self.starts)[doc]
        many = p.start[which + 1] - p.start[which]
        item = p.owner[np.repeat(p.start[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        doc, place = np.repeat(doc, many), np.repeat(place, many)
        order = np.lexsort((place, item, doc))
        spans: list[list[int]] = []
        for d, q, a in zip(doc[order].tolist(), item[order].tolist(), place[order].tolist()):
            if spans and spans[-1][:2] == [d, q] and a <= spans[-1][3] + 1:  # overlapping and touching passages are one span
                spans[-1][3] = max(spans[-1][3], a + p.size - 1)
            else:
                spans.append([d, q, a, a + p.size - 1])
        return spans


_SCHEMA = "question_id string, first_word int, last_word int, char_from int, char_to int"


def _scan(block, shard: int):
    def run(batches):
        p, held, kind = block.value, Shard(), None

        def rows(s: Shard):
            spans = s.search(p)
            if not spans:
                return
            places = {d: [m.span() for m in _WORD.finditer(s.texts[d])] for d in {x[0] for x in spans}}
            c = list(zip(*[(s.keys[d], p.ids[q], a, e, places[d][a][0], places[d][e][1]) for d, q, a, e in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], kind), pa.array(c[1], pa.string()), *[pa.array(x, pa.int32()) for x in c[2:]]], names=["_k", *[x.split()[0] for x in _SCHEMA.split(", ")]]
            )

        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.add(key, text)
                if len(held.words) >= shard:
                    yield from rows(held)
                    held = Shard()
        if held.keys:
            yield from rows(held)

    return run


def leaked_passages(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "question_id", item_text: str = "query", size: int = PASSAGE, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(key, question_id, first_word, last_word, char_from, char_to): merged spans of each test item in each document, words and characters from 0.

    Null texts and texts shorter than a passage hold none; test items shorter than a passage, or null, are never found.
    The suite passes the driver as a stream; what is held and sent out is a block of ``block_words`` words at most, and a suite
    that is larger scans the corpus once per block. Rows with equal or null keys each have their own rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") >= 2 * size - 1)
    out = None
    block: list[tuple[str, list[str]]] = []
    held = 0

    def scan(block):
        # the broadcast lies in a file, not in the memory of the driver
        part = src.mapInArrow(_scan(spark.sparkContext.broadcast(Phrases(block, size)), shard_words), f"_k {kind}, {_SCHEMA}")
        return part if out is None else out.unionByName(part)

    # the item ids are strings in the output
    for r in items.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("q")).where("i is not null and q is not null").orderBy("i").toLocalIterator():
        ws = words(r.q)
        if len(ws) < size:
            continue
        block.append((r.i, ws))
        held += len(ws)
        if held >= block_words:
            out, block, held = scan(block), [], 0
    if block or out is None:
        out = scan(block)
    return out.withColumnRenamed("_k", key)


def removal_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, char_from, char_to, questions): what to cut from each document, the spans of all test items merged."""
    w = Window.partitionBy(key).orderBy("char_from", "char_to")
    reach = F.max("char_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("char_from") > reach).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min("char_from").alias("char_from"), F.max("char_to").alias("char_to"), F.countDistinct("question_id").alias("questions")).drop("_g")


def p7_spans(spark, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "questions"))


def p7_removals(spark, folder: str) -> DataFrame:
    return removal_spans(p7_spans(spark, folder))


def p7_found(spark, folder: str) -> DataFrame:
    return p7_spans(spark, folder).select("doc_id", "question_id").distinct()
