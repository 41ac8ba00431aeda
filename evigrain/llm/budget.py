"""Token budget per source, language and kind (problem 1).

The estimate segments text as a unigram tokenizer does: pieces of a public vocabulary lie in a double-array trie,
and a count-only Viterbi pass over each normalised segment (a word with the spaces before it) finds how many
pieces the likeliest segmentation has; what no piece covers falls back to bytes. The public piece vocabulary holds
ranks, not probabilities; Zipf's law turns a rank into a log probability. Segments repeat, so those of a batch are
counted once, all together: the trie is walked for every segment at a time. The trie is packed once, on the driver, and sent out; its
size is that of the vocabulary, and checked.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.sources.tables import current, norm_word, table

#: Shift of Zipf's law: log probability of the piece of rank r is -log(r + SHIFT).
SHIFT = 10.0
#: Longest segment that is counted together with others and remembered; entries that are remembered.
TOGETHER, REMEMBERED = 64, 400_000
UNKNOWN = "(unknown)"

_SEGMENT = re.compile(" *[^ ]+| +")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Trie:
    """A double-array trie of pieces: the child of state s by symbol c is base[s] + c if check there is s."""

    def __init__(self, pieces: dict[str, float]):
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.longest = max(map(len, pieces), default=1)
        children: list[dict[int, int]] = [{}]
        value = [math.nan]
        for p, v in pieces.items():
            s = 0
            for c in p:
                s = children[s].setdefault(self.code[c], len(children)) if self.code[c] in children[s] else self._grow(children, value, s, self.code[c])
            value[s] = v
        self._pack(children, value)

    @staticmethod
    def _grow(children, value, s, c) -> int:
        children[s][c] = len(children)
        children.append({})
        value.append(math.nan)
        return children[s][c]

    def _pack(self, children, value) -> None:
        a = len(self.code) + 1
        size = 2 * len(children) + 4 * a
        base, check, score = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -np.inf)
        at = {0: 0}
        check[0] = 0
        used = bytearray(size)
        used[0] = used[1] = 1  # no child can stand at 1
        start = 2  # few slots below are free
        order = [0]
        for s in order:
            kids = children[s]
            if not kids:
                continue
            cs = sorted(kids)
            t = used.find(0, max(start, cs[0] + 1))
            if len(cs) > 1:  # most states have one child, which takes the first free slot
                tries = 0
                while any(used[t - cs[0] + c] for c in cs[1:]):
                    t, tries = used.find(0, t + 1), tries + 1
                    if t < 0 or t + 2 * a >= len(used):
                        used.extend(bytes(size))
                        t = max(t, len(used) - size - 2 * a) if t >= 0 else len(used) - size - a
                if tries > 1000 and len(cs) > 20:
                    start = max(start, t - 4096)
            b = t - cs[0]
            while b + a >= len(base):
                base, check, score = np.append(base, np.zeros(size, np.int32)), np.append(check, np.full(size, -1, np.int32)), np.append(score, np.full(size, -np.inf))
                used.extend(bytes(max(0, len(base) + a - len(used))))
            base[at[s]] = b
            for c in kids:
                x = b + c
                check[x], used[x] = at[s], 1
                v = value[kids[c]]
                score[x] = -np.inf if math.isnan(v) else v
                at[kids[c]] = x
                order.append(kids[c])
        self.base, self.check, self.score = base, check, score
        self._lists = None

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes + self.score.nbytes

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    def lists(self):
        """The arrays as lists, for walks one state at a time."""
        if self._lists is None:
            self._lists = self.base.tolist(), self.check.tolist(), self.score.tolist()
        return self._lists


class Counter:
    """Counts the pieces of the likeliest segmentation."""

    def __init__(self, pieces: dict[str, float]):
        self.trie = Trie(pieces)
        #: a byte costs more than any piece
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.seen: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def one(self, s: str) -> int:
        """Count-only Viterbi over one segment."""
        base, check, score = self.trie.lists()
        code, longest, top = self.trie.code, self.trie.longest, len(self.trie.base)
        n = len(s)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        cs = [code.get(c, 0) for c in s]
        for i in range(n):
            b0, n0 = best[i], count[i]
            state = 0
            for j in range(i, min(n, i + longest)):
                if not cs[j]:
                    break
                t = base[state] + cs[j]
                if t >= top or check[t] != state or not t:
                    break
                v = b0 + score[t]
                if v > best[j + 1]:
                    best[j + 1], count[j + 1] = v, n0 + 1
                state = t
            if best[i + 1] == -math.inf:  # no piece ends here: the character falls back to bytes
                k = len(s[i].encode("utf-8", "surrogatepass"))
                best[i + 1], count[i + 1] = b0 + k * self.byte, n0 + k
        return count[n]

    def many(self, segments: list[str]) -> np.ndarray:
        """The same for many segments of similar length at once."""
        t = self.trie
        n = np.fromiter(map(len, segments), np.int64, len(segments))
        m, width = len(segments), int(n.max())
        codes = np.zeros((width + 1, m), np.int32)
        size = np.ones((width + 1, m), np.int64)
        get = t.code.get
        for k, s in enumerate(segments):
            codes[: len(s), k] = [get(c, 0) for c in s]
            if not s.isascii():
                size[: len(s), k] = [len(c.encode("utf-8", "surrogatepass")) for c in s]
        best, count = np.full((width + 1, m), -np.inf), np.zeros((width + 1, m), np.int64)
        best[0] = 0.0
        for i in range(width):
            live = np.flatnonzero(n > i)
            state = np.zeros(len(live), np.int64)
            for j in range(i, min(width, i + t.longest)):
                c = codes[j, live]
                to = t.base[state] + c
                ok = (c > 0) & (t.check[to] == state) & (to > 0)
                if not ok.any():
                    break
                live_ok, state = live[ok], to[ok]
                v = best[i, live_ok] + t.score[state]
                up = v > best[j + 1, live_ok]
                w = live_ok[up]
                best[j + 1, w], count[j + 1, w] = v[up], count[i, w] + 1
                live = live_ok
            none = np.flatnonzero((n > i) & np.isneginf(best[i + 1]))
            best[i + 1, none] = best[i, none] + size[i, none] * self.byte
            count[i + 1, none] = count[i, none] + size[i, none]
        return count[n, np.arange(m)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Pieces of each text; none for a null or empty one."""
        # a space is put before a text, and spaces are the vocabulary's mark of a word
        split = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = set().union(*split) - self.seen.keys() if split else set()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
            new = set().union(*split)
        local: dict[str, int] = {}
        by_size: dict[int, list[str]] = {}
        for s in new:
            if len(s) > TOGETHER:
                local[s] = self.one(s.replace(" ", "▁"))
            else:
                by_size.setdefault((len(s) + 3) // 4, []).append(s)
        for group in by_size.values():
            for o in range(0, len(group), 20_000):
                part = group[o : o + 20_000]
                if len(part) < 8:
                    self.seen.update((s, self.one(s.replace(" ", "▁"))) for s in part)
                else:
                    self.seen.update(zip(part, self.many([s.replace(" ", "▁") for s in part]).tolist()))
        if local:
            get = lambda s, seen=self.seen: seen[s] if s in seen else local[s]
        else:
            get = self.seen.__getitem__
        return [sum(map(get, ss)) for ss in split]


@lru_cache(maxsize=2)
def counter(path: str, shift: float = SHIFT) -> Counter:
    """A counter of the pieces of a public vocabulary; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            p, v = sp.id_to_piece(i), sp.get_score(i)
            # runs of spaces are pieces of their own, ranked before all others
            pieces[p] = -math.log(shift - 1) if v < -1e8 else -math.log(shift - v)
    return Counter(pieces)


#: Bytes of packed arrays that may be sent to the executors; a public vocabulary has a few million.
MOST_BYTES = 256 << 20


def _count_batches(shared, keys: int):
    def run(batches):
        c = shared.value
        for b in batches:
            for o in range(0, b.num_rows, 2000):
                s = b.slice(o, 2000)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:keys], pa.array(c.counts(s.column(keys).to_pylist()), pa.int64())], names=[*s.schema.names[:keys], "tokens"]
                )

    return run


def count_tokens(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """``df`` with its text column replaced by ``tokens``; null and empty texts have none. Rows stay where they are."""
    keep = [c for c in df.columns if c != text]
    fields = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens bigint"])
    c = counter(path or vocabulary())
    if c.trie.nbytes > MOST_BYTES:
        raise ValueError(f"a vocabulary of {c.trie.nbytes} bytes is too large to send to the executors")
    return df.select(*keep, text).mapInArrow(_count_batches(df.sparkSession.sparkContext.broadcast(c), len(keep)), schema)


def language(c: Column) -> Column:
    """Primary subtag of a language tag; blank, undetermined and null are unknown."""
    tag = F.regexp_extract(norm_word(c), "^[a-z]+", 0)
    return F.when(tag.isNull() | tag.isin("", "und"), F.lit(UNKNOWN)).otherwise(tag)


def estimates(genes: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """(tbl, record_id, source, lang, kind, chars, tokens): the current delivery of each gene, and each document.

    Unknown values (null, blank, undetermined, metadata that can't be read) become one value of their own. Texts
    are counted before deliveries are compared, so texts are never shuffled.
    """
    known = lambda c: F.coalesce(norm_word(c), F.lit(UNKNOWN))
    g = genes.select(
        F.col("id").alias("record_id"),
        "ingest_seq",
        known("source_id").alias("source"),
        language(F.get_json_object("metadata_json", "$.lang")).alias("lang"),
        known("kind").alias("kind"),
        F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("chars"),
        "content",
    )
    g = current(count_tokens(g, "content", path), "record_id", "ingest_seq", "source", "lang", "kind", "chars", "tokens")
    d = documents.select(
        F.col("doc_id").cast("string").alias("record_id"),
        known("source").alias("source"),
        language(F.col("lang")).alias("lang"),
        known("kind").alias("kind"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"),
        "text",
    )
    d = count_tokens(d, "text", path)
    cols = ["record_id", "source", "lang", "kind", "chars", "tokens"]
    return g.select(F.lit("genes").alias("tbl"), *cols).unionByName(d.select(F.lit("documents").alias("tbl"), *cols))


def totals(records: DataFrame) -> DataFrame:
    """Totals by source, by language, by kind, by all three and over all, for each table.

    ``slice`` names the dimensions of a row; the others are null. Records are summed by all three first, on the
    map side too, so a source that holds a third of the rows is a few rows when it is shuffled.
    """
    fine = records.groupBy("tbl", "source", "lang", "kind").agg(F.count("*").alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    some = fine.groupingSets([["tbl", "source"], ["tbl", "lang"], ["tbl", "kind"], ["tbl", "source", "lang", "kind"], ["tbl"]], "tbl", "source", "lang", "kind").agg(
        F.grouping_id("tbl", "source", "lang", "kind").alias("g"), F.sum("records").alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")
    )
    name = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "lang").when(F.col("g") == 6, "kind").when(F.col("g") == 0, "source+lang+kind").otherwise("all")
    return some.select("tbl", name.alias("slice"), "source", "lang", "kind", "records", "chars", "tokens")


def p1_budget(spark, folder: str) -> DataFrame:
    return totals(p1_estimates(spark, folder))


def p1_estimates(spark, folder: str) -> DataFrame:
    return estimates(table(spark, folder, "genes"), table(spark, folder, "documents"))
