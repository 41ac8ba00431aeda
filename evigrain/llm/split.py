"""Splitting oversized texts at natural boundaries by content-defined chunking (problem 3).

A rolling hash over the characters marks landmarks that depend only on the text around them. From the start of a
piece the first landmark behind the minimum size is taken and snapped to the nearest boundary of the strongest kind; without a
landmark the best boundary before the maximum size is taken. Since landmarks move with the text, an edit alters
only the pieces near it. Each piece is preceded by an overlap with its predecessor that starts at a boundary too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.sources.tables import latest, table

LIMIT, OVERLAP = 1500, 100
#: Smallest own part of a piece (the last may be smaller), window of the rolling hash, and one landmark in so many.
LEAST, WINDOW, RARITY = 600, 24, 256
#: How far a landmark may be moved to reach a natural boundary.
SNAP = 200

# Kinds of boundary, strongest first: blank line, line end, sentence end, clause end, white space.
_PATTERNS = [
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    re.compile(r"\r\n|\r|\n|[\x0b\x0c\x85  ]"),
    re.compile("[.!?…][\"'”’»)\\]]*\\s+|[。！？]"),
    re.compile("[,;:]\\s+|[、，；：]"),
    re.compile(r"\s+"),
]
#: A character that must not be cut from the one before it: marks, joiners, variation selectors, skin tones.
_GLUE = re.compile("[̀-ͯ҃-҉֑-ֽً-ٟऀ-ःऺ-ॏ᪰-᫿᷀-᷿‌‍⃐-⃿゙゚︀-️︠-︯\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]")
_LINES = re.compile(r"\r\n|\r|\n")
_ANCHOR = re.compile(r"^(?P<path>.*?)(?:(?P<style>#L|:)(?P<a>\d+)(?:-L?(?P<b>\d+))?)?$", re.S)


def landmarks(text: str) -> np.ndarray:
    """Positions whose preceding WINDOW characters hash to a multiple of RARITY."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(len(c) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + c[i : i + len(h)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(RARITY) == 0) + WINDOW


def _ranked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of natural boundaries in order, and the rank of each (0 is strongest)."""
    best: dict[int, int] = {}
    for rank, p in enumerate(_PATTERNS):
        for m in p.finditer(text):
            best.setdefault(m.end(), rank)
    at = np.array(sorted(best), np.int64)
    return at, np.array([best[int(x)] for x in at], np.int64)


def _safe(text: str, at: int, low: int) -> int:
    """A place at or before ``at`` that parts no line end and no composed character."""
    p = at
    while p > low + 1 and (_GLUE.match(text, p) or text[p - 1] == "‍" or (text[p - 1] == "\r" and text[p] == "\n")):
        p -= 1
    return p if p > low + 1 else at


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the own parts of the pieces of a text; the last is its length."""
    n, most = len(text), limit - overlap
    if n <= limit:
        return [n]
    marks = landmarks(text)
    at, rank = _ranked(text)
    least, snap = min(LEAST, most // 2), min(SNAP, most // 4)
    out, a = [], 0
    while n - a > most:
        low, high = a + least, a + most
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else None
        near, far = (max(low, mark - snap), min(high, mark + snap)) if mark is not None else (low, high)
        i, j = np.searchsorted(at, near), np.searchsorted(at, far, side="right")
        if i == j:
            near, far = low, high
            i, j = np.searchsorted(at, near), np.searchsorted(at, far, side="right")
        if i < j:
            p, r = at[i:j], rank[i:j]
            p = p[r == r.min()]  # the strongest kind within reach, then the nearest to the landmark
            a = int(p[np.argmin(np.abs(p - mark))]) if mark is not None else int(p[-1])
        else:
            a = _safe(text, mark if mark is not None else high, a)
        out.append(a)
    return [*out, n]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of each piece, overlap included; no piece is longer than ``limit``."""
    ends, out, a = cuts(text, limit, overlap), [], 0
    for e in ends:
        s = a
        if a and overlap:
            low = max(0, a - overlap)
            s = _safe_start(text, _overlap_start(text, low, a), a)
        out.append((s, e))
        a = e
    return out


def _overlap_start(text: str, low: int, a: int) -> int:
    """The first place behind white space, else behind punctuation, else ``low``; the cut at ``a`` itself is none."""
    for p in (_PATTERNS[4], _PATTERNS[2], _PATTERNS[3]):
        for m in p.finditer(text, low, a):
            if m.end() < a:
                return m.end()
    return low


def _safe_start(text: str, s: int, a: int) -> int:
    while s < a and (_GLUE.match(text, s) or text[s - 1] == "‍" or (text[s - 1] == "\r" and text[s] == "\n")):
        s += 1
    return s


def place(location: str | None, text: str, s: int, e: int) -> str:
    """Place of text[s:e] derived from the place of the whole.

    A place with a line keeps its style, its lines counted on from the first; line ranges that were given end
    where they ended at the latest. A place without a line gets the range of characters. No place stays empty.
    """
    m = _ANCHOR.match(location or "")
    if not location or not m or not m["path"]:
        return location or ""
    if m["a"] is None:
        return f"{location}#char={s},{e}"
    first = int(m["a"])
    a = first + len(_LINES.findall(text[:s]))
    body = text[s:e]
    b = a + len(_LINES.findall(body.rstrip("\r\n")))
    if m["b"]:
        last = max(first, int(m["b"]))
        a, b = min(a, last), min(b, last)
    return f"{m['path']}#L{a}-L{b}" if m["style"] == "#L" else f"{m['path']}:{a}" if a == b else f"{m['path']}:{a}-{b}"


_SCHEMA = "gene_id string, piece_no int, n_pieces int, char_from bigint, char_to bigint, own_from bigint, piece_location string, piece string"


#: Pieces that are handed on together.
_BATCH = 1000


def _split(limit: int, overlap: int):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for gid, loc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                p, own = pieces(text, limit, overlap), 0
                for no, (s, e) in enumerate(p, 1):
                    rows.append((gid, no, len(p), s, e, own, place(loc, text, s, e), text[s:e]))
                    own = e
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def split_oversized(genes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered pieces of every text longer than ``limit`` characters, of the current delivery of each id.

    Null and short contents have no pieces; a null place gives an empty one. Deliveries of one record count once,
    records without id are dropped. Only oversized rows leave the scan, and of these only the contents of records that were
    delivered more than once are shuffled. A landmark snaps to the nearest boundary of the strongest kind within reach, since the
    nearest of any kind would nearly always be a space inside a sentence.
    """
    big = genes.select("id", "source_location", "content", "ingest_seq").where(F.length("content") > limit)
    one = latest(big, "id", "ingest_seq", "source_location", "content")
    return one.select("id", "source_location", "content").mapInArrow(_split(limit, overlap), _SCHEMA)


def p3_pieces(spark, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "genes"))


def p3_found(spark, folder: str) -> DataFrame:
    """Each id that has pieces: the first piece of each stands for it."""
    return p3_pieces(spark, folder).where("piece_no = 1").select("gene_id")
