"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Short texts are encoded where they lie: a narrow pass over Arrow batches, no shuffle. Longer texts go the
overlapping-chunk way: cut into chunks that overlap, pre-tokenise the chunks in parallel, stitch where the
pre-token boundaries of two neighbours resynchronise, encode the stitched pieces in parallel and put the ids
together again. The result equals encoding the text in one go. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.sources.tables import table

#: Characters of a chunk's own part, and how far it reaches into its neighbours.
CHUNK, OVERLAP = 8192, 256


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pre_token():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of a text."""
    return [m.start() for m in pre_token().finditer(text)]


def chunk_spans(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of each overlapping chunk of a text of n characters."""
    return [(max(0, a - overlap), min(n, a + chunk + overlap)) for a in range(0, n, chunk)]


def stitch(chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """Pieces of one text from its overlapping chunks (start, body, local pre-token starts), in order.

    A cut is made at a place that is a pre-token boundary of both neighbours and follows a character that is no
    white space; there a pre-token of either ends for good, so both pieces encode as the whole would. The scan of
    a chunk is trusted from the last cut on; where the overlap holds no common boundary the chunks are joined and
    scanned again as one.
    """
    pieces: list[str] = []
    start, body, bounds = chunks[0]
    for s, b, bb in chunks[1:]:
        end = start + len(body)
        mine = {start + x for x in bounds}
        low = s - start
        cut = next((s + x for x in bb if 0 < x < end - s and s + x in mine and not body[low + x - 1].isspace()), None)
        if cut is None:
            body += b[end - s :]
            bounds = boundaries(body)
        else:
            pieces.append(body[: cut - start])
            body, start = b[cut - s :], cut
            bounds = [x - (cut - s) for x in bb if s + x >= cut]
    pieces.append(body)
    return pieces


def _id_lists(encoder, texts: list[str | None]) -> pa.Array:
    ids = [encoder(t) if t else [] for t in texts]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_batches(path: str, keys: list[str], text: str):
    def run(batches):
        enc = encoding(path).encode_ordinary
        for b in batches:
            at = b.schema.get_field_index(text)
            # in slices, so that the Python lists of ids of a batch never exist all at once
            for o in range(0, b.num_rows, 512):
                s = b.slice(o, 512)
                yield pa.RecordBatch.from_arrays(
                    [s.column(s.schema.get_field_index(k)) for k in keys] + [_id_lists(enc, s.column(at).to_pylist())],
                    names=[*keys, "ids"],
                )

    return run


def _split_batches(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = chunk_spans(len(text), chunk, overlap)
                for o in range(0, len(spans), 256):
                    part = spans[o : o + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid] * len(part), pa.string()),
                            pa.array(range(o, o + len(part)), pa.int32()),
                            pa.array([a for a, _ in part], pa.int64()),
                            pa.array([text[a:e] for a, e in part]),
                        ],
                        names=["uid", "chunk_no", "start", "body"],
                    )

    return run


def _bound_batches(batches):
    for b in batches:
        bodies = b.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([boundaries(t) for t in bodies], pa.list_(pa.int32()))],
            names=["uid", "chunk_no", "start", "body", "bounds"],
        )


def _stitch_group(t: pa.Table) -> pa.Table:
    # equal texts under equal keys have one name; their chunks are the same
    rows = {n: x for n, *x in zip(*(t.column(c).to_pylist() for c in ("chunk_no", "start", "body", "bounds")))}
    pieces = stitch([tuple(rows[n]) for n in sorted(rows)])
    uid = t.column("uid")[0].as_py()
    return pa.table(
        {
            "uid": pa.array([uid] * len(pieces), pa.string()),
            "piece_no": pa.array(range(len(pieces)), pa.int32()),
            "piece": pa.array(pieces, pa.string()),
        }
    )


def encode_ids(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(key, ids) for every row of ``docs``.

    Null and empty texts have an empty list; blank texts are encoded like any other; strings that look like
    control marks are plain text. Rows with equal or null keys each keep their own row. Extra columns are ignored.
    """
    path = path or vocabulary()
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = src.schema["_k"].dataType.simpleString()
    long = F.coalesce(F.length("_t"), F.lit(0)) > chunk
    short_ids = src.where(~long).mapInArrow(_encode_batches(path, ["_k"], "_t"), f"_k {kind}, ids array<int>")
    # the name of a row comes from what it holds, so that a retry gives it again
    tall = src.where(long).withColumn("uid", F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("_k").cast("string"), F.lit("\x00")), "_t"), 256))
    chunks = tall.select("uid", "_t").mapInArrow(_split_batches(chunk, overlap), "uid string, chunk_no int, start bigint, body string")
    scanned = chunks.repartition("uid", "chunk_no").mapInArrow(_bound_batches, "uid string, chunk_no int, start bigint, body string, bounds array<int>")
    # one text's chunks meet here: no more than the text itself, which one row already holds
    pieces = scanned.groupBy("uid").applyInArrow(_stitch_group, "uid string, piece_no int, piece string")
    ids = (
        pieces.repartition("uid", "piece_no")
        .mapInArrow(_encode_batches(path, ["uid", "piece_no"], "piece"), "uid string, piece_no int, ids array<int>")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("piece_no", "ids"))).alias("p"))
        .select("uid", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))
    )
    long_ids = tall.select("uid", "_k").join(ids, "uid").select("_k", "ids")
    return short_ids.unionByName(long_ids).select(F.col("_k").alias(key), "ids")


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """The text of a list of ids: raw bytes concatenated, then read as UTF-8."""
    enc = encoding(path or vocabulary())
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def p6_ids(spark, folder: str) -> DataFrame:
    return encode_ids(table(spark, folder, "documents"))
