"""Near-duplicate records: multi-index Hamming join of word signatures with enumerated chunk errors (problem 2).

A record's signature is a wide bit vector with one bit per hashed word. Two word sets of sizes a <= b have a Jaccard
similarity of 0.8 or more exactly if their signatures differ in at most T = (a + b) / 9 bits, and no more of these are the
smaller set's than the larger one's. The signature is split into chunks, and each chunk may hold one error: the larger
record's bit. It is enumerated, every record standing in the index under each of its chunks as it is and, for partners that
are smaller, under each chunk with one bit cleared. A chunk fails only by a bit of the smaller record or by two of the
larger, so at most T/2 + (T/2)/2 chunks fail; there are SPARE more, so by the pigeonhole principle every pair meets in
that many chunks at least. Sizes are cut into bands, since T grows with the size; in the next band, where larger
partners may be, a record stands with its plain chunks only.

An index row is two numbers: the key of a chunk, and a handle of the record, which holds its size and a 54-bit digest
of its signature whose distance never exceeds that of the signatures. A key under which too many would be compared is hot
and compares nothing; what meets there meets in another chunk as well, so the hot keys of a record are combined in twos
and these are indexed, exactly. Where even a combination holds too many for one task, its rows are cut into blocks, and
every two blocks are a task's. Candidates are then compared by sketches that grow with the sets, and only what these
leave by its words. Equal word sets form one class and are compared once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.operators.components import components
from evigrain.session import materialise, release
from evigrain.sources.tables import norm_ref, table

#: Similarity 0.8 = NUM / DEN: a distance of at most (a + b) * (DEN - NUM) / (DEN + NUM) bits.
NUM, DEN = 4, 5
#: A key is hot if more comparisons than HOT * HOT / 2 stand under it.
HOT = 64
#: Rows of a block of a combination that is too large for one task.
BLOCK = 4096
#: Index rows that a task sorts, some 200 MB.
TASK_ROWS = 8_000_000
#: Comparisons that are held in memory at a time.
AT_ONCE = 1 << 21
#: Bits of the digest in a handle; sets of so few words have a hash there instead, as their digests would coincide.
DIGEST, FEW = 54, 9
_MASK = (1 << DIGEST) - 1
#: Bits of a key that hold its chunk, the parity of its band, and whether a bit is cleared.
SLOT = 14

_WORD = re.compile(r"\w{2,}")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> set[str]:
    """Distinct lower-cased runs of letters, digits and underscores of at least two characters."""
    return {w.lower() for w in _WORD.findall(text)}


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)


def _scale(x: np.ndarray, m) -> np.ndarray:
    """Hashes as even numbers below m."""
    return ((x >> np.uint64(32)) * np.asarray(m).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def bands(most: int) -> list[int]:
    """Smallest size of each band, up to one that holds ``most``; each band is 5/4 as wide as its start."""
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, low[-1] * DEN // NUM + 1))
    return low


def bound(a, b):
    """Largest distance of two signatures of sets of these sizes with the similarity asked for."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def spare(t):
    """Chunks in which a pair meets at least; more for long sets, so that fewer hot keys need be combined."""
    return (2 + t // 16) * (1 + t // (1 << SLOT))


def chunks(t):
    """Chunks for a distance of ``t``: those that may fail, and the spare ones."""
    return t // 2 + (t + 1) // 2 // 2 + spare(t)


_SIGNED = "id string, locus_id string, c1 bigint, c2 bigint, n int, d bigint, sketch array<bigint>, words array<bigint>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _parities(h: np.ndarray, n: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The parity sketches of several sets, one after the other, in words of 64 bits; a narrow one is a wide one folded."""
    place = (_mix(h, 3) >> np.uint64(20)).astype(np.int64) & (np.repeat(width, n) * 64 - 1)
    base = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(out, np.repeat(base, n) + place // 64, np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
    return out


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a sketch: four bits or more for each member, a power of two."""
    return 1 << np.maximum(2, np.ceil(np.log2(np.maximum(n, 1) / 16)).astype(np.int64))


def _sign(batches):
    """Word hashes, class, handle and sketch of each record; records without words are left out."""
    for b in batches:
        ids, loci = b.column(0), b.column(1)
        sets = [words(t) for t in b.column(2).to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        keep = np.flatnonzero(n)
        if not len(keep):
            continue
        codes, uniques = pd.factorize(np.array([w for s in sets for w in s], dtype=object))
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in uniques), np.uint64, len(uniques))
        h = hashed[codes]
        n = n[keep]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        # the words of a record in the order of their hashes
        h = h[np.lexsort((h, np.repeat(np.arange(len(n)), n)))]
        c1 = np.add.reduceat(_mix(h, 1), start)
        bits = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), _scale(_mix(h, 2), DIGEST).astype(np.uint64)), start)
        low = np.where(n < FEW, c1 & np.uint64(_MASK), bits)
        d = np.minimum(n, 1023).astype(np.uint64) << np.uint64(DIGEST) | low
        width = sketch_words(n)
        lists = lambda x, m: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.array(x.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(keep)), loci.take(pa.array(keep)), pa.array(c1.view(np.int64)), pa.array(np.add.reduceat(_mix(h, 8), start).view(np.int64)),
                pa.array(n.astype(np.int32)), pa.array(d.view(np.int64)), lists(_parities(h, n, width), width), lists(h, n),
            ],
            names=_names(_SIGNED),
        )


_KEYS = "key bigint, d bigint"


def _index(batches):
    """(key, handle) rows of each set: its chunks in its own band, plain and with each bit cleared, and plain in the next."""
    for b in batches:
        d, n, w = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2)
        h = w.flatten().to_numpy().view(np.uint64)
        _, first = np.unique(d, return_index=True)
        # copies within a batch are indexed once, but sets that only share a handle are all
        first = np.arange(len(d)) if len(first) == len(d) else _distinct(d, n, h)
        low = np.array(bands(int(n.max(initial=1))), np.int64)
        own = np.searchsorted(low, n, side="right") - 1
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        for visiting in (0, 1):
            g = own + visiting
            rows = first if not visiting else first[(g[first] < len(low)) & (DEN * n[first] >= NUM * low[np.minimum(g[first], len(low) - 1)])]
            if not len(rows):
                continue
            high = np.append(low[1:], low[-1] * DEN // NUM + 1)[g[rows]] - 1
            t = bound(high, high)
            m = chunks(t)
            x = h[np.repeat(start[rows], n[rows]) + _ramp(n[rows])]
            row = np.repeat(np.arange(len(rows)), n[rows])
            base = np.concatenate([[0], np.cumsum(m)[:-1]])
            at = base[row] + _scale(_mix(x, 4), np.repeat(m, n[rows]))
            # value of a chunk: its words, order-free; an empty chunk has a value too
            value, each = np.zeros(int(m.sum()), np.uint64), _mix(x, 5)
            np.add.at(value, at, each)
            of, no = np.repeat(np.arange(len(rows)), m), _ramp(m)
            band = g[rows][of].astype(np.uint64)
            tag = _mix(band << np.uint64(32) | no.astype(np.uint64), 6)
            place = (no & ((1 << SLOT) - 1)).astype(np.uint64) << np.uint64(2) | (band & np.uint64(1)) << np.uint64(1)
            clear = ~np.uint64((1 << (SLOT + 2)) - 1)
            keys, owner = [_mix(value + tag, 7) & clear | place], [of]
            if not visiting:
                some = t[row] > 0
                a = at[some]
                keys.append(_mix(value[a] - each[some] + tag[a], 7) & clear | place[a] | np.uint64(1))
                owner.append(row[some])
            for k, o in zip(keys, owner):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d[rows][o])], names=_names(_KEYS))


def _distinct(d: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first of each group of equal sets."""
    whole = np.add.reduceat(_mix(h, 1), np.concatenate([[0], np.cumsum(n)[:-1]]))
    return np.unique(np.stack([d.view(np.uint64), whole], 1), axis=0, return_index=True)[1]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the sizes and digests of two handles allow to be within the bound."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    na, nb = (a >> np.uint64(DIGEST)).astype(np.int64), (b >> np.uint64(DIGEST)).astype(np.int64)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    far = np.bitwise_count((a ^ b) & np.uint64(_MASK)) > bound(na, nb)
    # 1023 stands for any larger size too
    return (NUM * large <= DEN * small) & ~(far & (small >= FEW) & (large < 1023))


def _met(key: np.ndarray, d: np.ndarray, cost: np.ndarray, end: np.ndarray):
    """Distinct pairs of handles that meet: every plain row with all rows behind it in its run; ``cost`` is how many these are."""
    stop = np.cumsum(cost)
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + AT_ONCE, side="right")))
        c = cost[i:j]
        x = np.repeat(np.arange(i, j), c)
        # a row with more partners than are held at once is taken in parts
        y = x + 1 + _ramp(c)
        for o in range(0, len(x), AT_ONCE):
            a, b = d[x[o : o + AT_ONCE]], d[y[o : o + AT_ONCE]]
            cleared = (key[y[o : o + AT_ONCE]] & 1) == 1
            # the record whose bit is cleared is the larger one
            ok = (a != b) & ~(cleared & ((a >> DIGEST & 1023) > (b >> DIGEST & 1023))) & _near(a, b)
            if ok.any():
                p = np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], 1)
                yield np.unique(p, axis=0)
        i = j


_OUT = "a bigint, b bigint, key bigint, d bigint"


def _buckets(limit: int | None):
    """Pairs that meet under equal keys of sorted input; rows of keys with more comparisons than ``limit`` go on, with no partner."""

    def pairs(p):
        z = pa.nulls(len(p), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), z, z], names=_names(_OUT))

    def hot(key, d):
        z = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([z, z, pa.array(key), pa.array(d)], names=_names(_OUT))

    def work(key, d):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
        key, d = key[fresh], d[fresh]
        run = key >> 1
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        end = np.repeat(begin + size, size)
        cost = np.where(key & 1, 0, end - 1 - np.arange(len(key)))
        total = np.add.reduceat(cost, begin)
        big = np.repeat(total > (np.inf if limit is None else limit), size)
        if big.any():
            yield hot(key[big], d[big])
            cost = np.where(big, 0, cost)
        for p in _met(key, d, cost, end):
            yield pairs(p)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the run that may go on
        plain = others = 0
        streamed = None  # a run known to be hot passes through
        for b in batches:
            key, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            runs = key >> 1
            if streamed is not None and len(key):
                cut = int(np.searchsorted(runs, streamed, side="right"))
                if cut:
                    yield hot(key[:cut], d[:cut])
                    key, d, runs = key[cut:], d[cut:], runs[cut:]
            if not len(key):
                continue
            streamed = None
            if not (held and runs[0] == runs[-1] == held[-1][0][-1] >> 1):
                cut = int(np.searchsorted(runs, runs[-1]))
                parts = [*held, (key[:cut], d[:cut])]
                k = np.concatenate([x for x, _ in parts])
                if len(k):
                    yield from work(k, np.concatenate([x for _, x in parts]))
                key, d, held, plain, others = key[cut:], d[cut:], [], 0, 0
            held.append((key, d))
            cleared = int((key & 1).sum())
            plain, others = plain + len(key) - cleared, others + cleared
            if limit is not None and plain * (plain - 1) // 2 + plain * others > 4 * limit:
                for k, x in held:
                    yield hot(k, x)
                streamed, held, plain, others = int(key[-1] >> 1), [], 0, 0
        if held:
            yield from work(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))

    return run


def _groups(n: np.ndarray, parity: np.ndarray) -> np.ndarray:
    """How many groups the chunks of a band are cut into, by a record's size and the parity of the band: one fewer than it has
    spare ones. Bands that hold sizes a handle can't tell have one group."""
    low = np.array(bands(2048), np.int64)
    g = np.searchsorted(low, n, side="right") - 1
    g = np.where((g & 1) == parity, g, g + 1)
    high = low[g + 1] - 1
    return np.where(high >= 1023, 1, spare(bound(high, high)) - 1)


def _combine(batches):
    """Hot keys of each handle in twos: of different chunks of one band, and of one group of chunks.

    A pair meets in ``spare`` chunks at least; cut into one group fewer, two of these fall into one group.
    """
    for b in batches:
        d, lists = b.column(0).to_numpy(), b.column(1)
        many = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        k = lists.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(d)), many)
        no, parity = (k >> np.uint64(2)).astype(np.int64) & ((1 << SLOT) - 1), (k >> np.uint64(1)).astype(np.int64) & 1
        slot = 2 * (no % _groups((d >> DIGEST & 1023)[owner], parity)) + parity
        order = np.lexsort((k, slot, owner))
        k, slot, owner, no = k[order], slot[order], owner[order], no[order]
        if not len(k):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])]))
        size = np.diff(np.append(begin, len(k)))
        left = np.repeat(begin + size, size) - 1 - np.arange(len(k))
        stop, at = np.cumsum(left), 0
        while at < len(k):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + AT_ONCE, side="right")))
            i = np.repeat(np.arange(at, to), left[at:to])
            j = i + 1 + _ramp(left[at:to])
            ok = no[i] != no[j]
            i, j = i[ok], j[ok]
            x, y = k[i] & ~np.uint64(1), k[j] & ~np.uint64(1)
            key = _mix(_mix(np.minimum(x, y), 9) + np.maximum(x, y), 10) & ~np.uint64(1) | (k[i] | k[j]) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d[owner[i]])], names=_names(_KEYS))
            at = to


def signed(genes: DataFrame, key: str = "id", subject: str = "locus_id", text: str = "content") -> DataFrame:
    """Word signature of each record: one row per delivery; null keys and texts without words are left out."""
    src = genes.select(F.col(key).alias("id"), norm_ref(subject).alias("locus_id"), F.col(text).alias("content"))
    return src.where(F.col("id").isNotNull() & F.col("content").isNotNull()).mapInArrow(_sign, _SIGNED)


def candidates(s: DataFrame) -> DataFrame:
    """(da, db): handles of sets that may be within the bound; a superset that holds every pair within it."""
    spark = s.sparkSession
    # an index has a row for each word and half as many more; a task sorts no more than TASK_ROWS
    rows = (s.agg(F.sum("n")).first()[0] or 0) * 3 // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    run = F.expr("shiftright(key, 1)")

    def meet(keys: DataFrame, limit: int | None) -> DataFrame:
        return keys.repartition(parts, run).sortWithinPartitions("key", "d").mapInArrow(_buckets(limit), _OUT)

    level1 = materialise(meet(s.select("d", "n", "words").mapInArrow(_index, _KEYS), HOT * HOT // 2), "neardup-level1")
    hot = level1.where("a is null").groupBy("d").agg(F.collect_set("key").alias("keys")).where("size(keys) > 1")
    level2 = materialise(meet(hot.mapInArrow(_combine, _KEYS), BLOCK * BLOCK // 2), "neardup-level2")
    # every row of a crowded combination stands in the task of its block with each other block; its last bit stays
    crowd = level2.where("a is null").select("key", "d", run.alias("run"))
    blocks = crowd.groupBy("run").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block, other = F.pmod(F.xxhash64("d"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    each = crowd.join(blocks, "run").select("key", "d", "run", block.alias("block"), other)
    task = F.xxhash64("run", F.least("block", "other"), F.greatest("block", "other"))
    level3 = meet(each.select(task.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("key").bitwiseAND(F.lit(1))).alias("key"), "d"), None)
    met = lambda df: df.where("a is not null").select("a", "b")
    found = met(level1).unionByName(met(level2)).unionByName(met(level3)).distinct()
    out = materialise(found.withColumnsRenamed({"a": "da", "b": "db"}), "neardup-candidates")
    release(level1, level2)
    return out


def similar_classes(s: DataFrame) -> DataFrame:
    """(a, a2, b, b2, similarity): pairs of different word sets of 0.8 or more, by their 128-bit class ids.

    Sets whose handles are equal are candidates too. Sketches are compared first: of the narrower width, to which the wider one is folded.
    """
    found = candidates(s)
    k = s.groupBy("c1", "c2").agg(F.first("d").alias("d"), F.first("n").alias("n"), F.first("sketch").alias("k"))
    side = lambda x, y: k.select(F.col("c1").alias(x), F.col("c2").alias(f"{x}2"), F.col("d").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"))
    left, right = side("a", "wa"), side("b", "wb")
    cross = found.join(left, "da").join(right, "db")
    # equal handles mean equal sizes, and such sets differ in two words at least: none of fewer than FEW can be similar
    twins = left.where(F.col("na") >= FEW).join(right, F.col("da") == F.col("db")).where("a < b or (a = b and a2 < b2)")
    both = cross.select(*left.columns, *right.columns).unionByName(twins.select(*left.columns, *right.columns))
    width = F.least(F.size("ka"), F.size("kb"))
    folded = lambda c: F.when(F.size(c) == width, F.col(c)).otherwise(
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(F.filter(c, lambda _, j: j % width == i), F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseXOR(v)))
    )
    distance = F.aggregate(F.zip_with(folded("ka"), folded("kb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    likely = both.where((F.greatest("na", "nb") * NUM <= F.least("na", "nb") * DEN) & (distance <= F.floor((F.col("na") + F.col("nb")) * (DEN - NUM) / (DEN + NUM))))
    likely = materialise(likely.select("a", "a2", "b", "b2", "na", "nb"), "neardup-likely")
    release(found)
    # words travel for what is left only
    asked = likely.select(F.explode(F.array(F.struct(F.col("a").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b").alias("c1"), F.col("b2").alias("c2")))).alias("x")).select("x.*").distinct()
    sets = s.select("c1", "c2", "words").join(asked, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.first("words").alias("words"))
    wa = sets.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), F.col("words").alias("wa"))
    wb = sets.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return (
        likely.join(wa, ["a", "a2"])
        .join(wb, ["b", "b2"])
        .withColumn("both", shared)
        .withColumn("either", F.col("na") + F.col("nb") - F.col("both"))
        .where(F.col("both") * DEN >= F.col("either") * NUM)
        .select("a", "a2", "b", "b2", (F.col("both") / F.col("either")).alias("similarity"))
    )


def similar_records(genes: DataFrame) -> DataFrame:
    """(gene_id_a, gene_id_b): pairs of distinct ids of different subjects whose word sets are similar.

    Deliveries of one record count once. Null subjects differ from none, so they pair with nothing; contents that
    are null, empty or without words neither. Equal contents of different subjects are pairs too.
    """
    s = materialise(signed(genes), "neardup-signed")
    pairs = similar_classes(s)
    members = s.select("c1", "c2", "id", "locus_id").distinct()
    ma = members.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), F.col("id").alias("x"), F.col("locus_id").alias("lx"))
    mb = members.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), F.col("id").alias("y"), F.col("locus_id").alias("ly"))
    cross = pairs.join(ma, ["a", "a2"]).join(mb, ["b", "b2"]).select("x", "lx", "y", "ly")
    mine = mb.withColumnsRenamed({"b": "a", "b2": "a2"})
    same = ma.join(mine, ["a", "a2"]).where("x < y").select("x", "lx", "y", "ly")
    return (
        cross.unionByName(same)
        .where("lx != ly and x != y")
        .select(F.least("x", "y").alias("gene_id_a"), F.greatest("x", "y").alias("gene_id_b"))
        .distinct()
    )


def p2_found(spark, folder: str) -> DataFrame:
    return similar_records(table(spark, folder, "genes"))


def similar_groups(genes: DataFrame) -> DataFrame:
    """(gene_id, class_id, group_id, links): one row per gene id of ``genes``.

    ``class_id`` is the smallest gene id with the same words, null where there are none; ``group_id`` the smallest of
    the group that the pairs of ``similar_records`` form, null for a gene without pairs; ``links`` the number of its
    pairs. Record pairs aren't built: records of one class and subject have the same partners, and a class of several
    subjects hangs together, so the groups are the components of the classes.
    """
    s = materialise(signed(genes), "neardup-signed")
    pairs = materialise(similar_classes(s).select("a", "a2", "b", "b2"), "neardup-pairs")
    members = s.select("c1", "c2", "id", "locus_id").distinct()
    nodes = materialise(members.where("locus_id is not null").groupBy("c1", "c2", "locus_id").agg(F.count("*").alias("n"), F.min("id").alias("rep")), "neardup-nodes")
    classes = nodes.groupBy("c1", "c2").agg(F.sum("n").alias("total"), F.min("rep").alias("rep"), F.min("locus_id").alias("low"), F.max("locus_id").alias("high"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.withColumnsRenamed({"c1": x, "c2": f"{x}2"} | {c: f"{c}_{x}" for c in df.columns if c not in ("c1", "c2")})

    # two classes of one and the same subject aren't linked
    joined = pairs.join(side(classes, "a"), ["a", "a2"]).join(side(classes, "b"), ["b", "b2"])
    linked = joined.where("low_a != high_a or low_b != high_b or low_a != low_b").select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
    roots = components(linked).withColumnsRenamed({"node": "rep", "root": "group_id"})
    grouped = classes.join(roots, "rep", "left").select("c1", "c2", "total", F.coalesce("group_id", F.when(F.col("low") != F.col("high"), F.col("rep"))).alias("group_id"))

    # partners of a (class, subject): all records of the similar classes and its own, less those of its subject
    twoway = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b2").alias("a2"), F.col("a").alias("b"), F.col("a2").alias("b2")))
    near = twoway.join(side(classes.select("c1", "c2", "total"), "b"), ["b", "b2"]).groupBy(F.col("a").alias("c1"), F.col("a2").alias("c2")).agg(F.sum("total_b").alias("near"))
    own = nodes.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), "locus_id")
    other = nodes.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), "locus_id", "n")
    barred = twoway.join(own, ["a", "a2"]).join(other, ["b", "b2", "locus_id"]).groupBy(F.col("a").alias("c1"), F.col("a2").alias("c2"), "locus_id").agg(F.sum("n").alias("barred"))
    zero = F.lit(0).cast("bigint")
    links = (
        nodes.join(grouped, ["c1", "c2"])
        .join(near, ["c1", "c2"], "left")
        .join(barred, ["c1", "c2", "locus_id"], "left")
        .select("c1", "c2", "locus_id", "group_id", (F.col("total") - F.col("n") + F.coalesce("near", zero) - F.coalesce("barred", zero)).alias("links"))
    )
    named = members.groupBy("c1", "c2").agg(F.min("id").alias("class_id"))
    out = members.join(named, ["c1", "c2"]).join(links, ["c1", "c2", "locus_id"], "left").select(F.col("id").alias("gene_id"), "class_id", "group_id", "links")
    ids = genes.where("id is not null").select(F.col("id").alias("gene_id")).distinct()
    return ids.join(out, "gene_id", "left").select("gene_id", "class_id", "group_id", F.coalesce("links", zero).alias("links"))


def p2_groups(spark, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "genes"))
