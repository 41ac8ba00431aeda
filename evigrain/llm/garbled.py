"""Garbled text from wrong character encodings: detection and round-trip repair (problem 8).

Text is re-encoded under a candidate legacy encoding and strictly decoded as the intended one; a repair is
accepted when the garbling cost of the passage drops, and repeated for nested layers. Two kinds are told apart:
multi-byte readings (UTF-8 or Japanese bytes read as a single-byte encoding), found sequence by sequence so that a
passage damaged in places is repaired in places, and single-byte swaps (one code page read as another), found by
the words they break. Lost characters (U+FFFD, stray C1 controls) are cases that can't be restored.
A span between single backticks on one line is an illustration and left alone.

Damage below a floor is no case: a Cyrillic page swap of fewer than 6 letters in all (8 for Western readings) or
without a word of 4, and multi-byte readings of a gain below 1.0 over the whole text. README has the measured misses.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.sources.tables import table

#: Encodings that UTF-8 bytes are taken for. "+" fills a code page's undefined bytes with C1 controls, as browsers do.
READ_AS = ["cp1252+", "latin-1", "iso8859-15", "cp1250+", "cp1251+", "cp1254+", "cp437", "cp850", "mac_roman", "cp866", "koi8-r", "cp1253+", "cp1257+", "iso8859-2", "cp852"]

_ILLUSTRATION = re.compile(r"(?<!`)`(?!`)[^`\r\n]*(?<!`)`(?!`)")
#: Odd characters with the letters beside them: all that the search for damage looks at.
_CONTEXT = re.compile("[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?")
_RUN = re.compile("[^\x00-\x7f]{2,}")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Character to byte and byte to character of a single-byte encoding, for the bytes from 0x80."""
    codec, fill = name.rstrip("+"), name.endswith("+")
    to_char = {}
    for b in range(128, 256):
        try:
            to_char[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            if fill:
                to_char[b] = chr(b)
    return {c: b for b, c in to_char.items()}, to_char


@lru_cache(maxsize=None)
def _sequence(name: str) -> re.Pattern:
    """Runs of characters that stand for well-formed multi-byte UTF-8 under an encoding."""
    _, ch = _tables(name)

    def cls(a: int, b: int) -> str:
        return "[" + "".join(re.escape(ch[x]) for x in range(a, b + 1) if x in ch) + "]"

    tail = cls(0x80, 0xBF)
    one = f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})"
    return re.compile(f"{one}+")


# What intended text is made of, besides ASCII: the letters of the languages of the corpus and common signs.
_LATIN = set("ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿŒœŠšŽžŁłŸ")
_OTHER_LATIN = set("ĂăĄąĆćČčĎďĐđĘęĚěĞğİıĹĺĽľŃńŇňŐőŔŕŘřŚśŞşŢţŤťŮůŰűŹźŻżÐðÞþƒ")


def _kind(c: str) -> str:
    """A coarse class of a character: latin, latin2, cyrillic, east (kana, CJK), sign, other."""
    o = ord(c)
    if c in _LATIN:
        return "latin"
    if 0x410 <= o <= 0x44F or c in "ЁёІіЇїЄєҐґ":
        return "cyrillic"
    if 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF01 <= o <= 0xFFEF or 0x3400 <= o <= 0x4DBF:
        return "east"
    if c in _OTHER_LATIN:
        return "latin2"
    if (
        0xA0 <= o <= 0xBF or c in "×÷" or 0x2000 <= o <= 0x206F or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x2BFF
        or 0x300 <= o <= 0x36F or 0x391 <= o <= 0x3C9 or o in (0xFEFF, 0xFE0F) or 0x1F000 <= o <= 0x1FAFF
    ):
        return "sign"
    if c in _page_characters():
        return "inner"
    # letters of any other script, and the marks they bear
    return "script" if unicodedata.category(c)[0] in "LM" and o < 0xE000 else "other"


def _block(c: str) -> str:
    """The script of a letter, as the first word of its name says."""
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=None)
def _page_characters() -> frozenset[str]:
    """What the candidate code pages have from 0x80: a nested layer may leave any of it."""
    return frozenset(c for name in READ_AS for c in _tables(name)[0])


def _evidence(seq: str, plain: str, name: str, before: str, after: str) -> float:
    """How much the garbling cost drops when ``seq`` is read as ``plain``; not above zero: no case.

    A letter or a sign that comes out of two or more odd ones is a gain. What correct text may hold by chance gains
    nothing: a lone Cyrillic pair (a word's end before a quote), a capital before closing punctuation, box drawing.
    A character that neither text nor a code page has lowers the gain, by its own share only.
    """
    kinds = ["c1" if "\x80" <= c < "\xa0" else _kind(c) for c in plain]
    if all("А" <= c <= "я" or c in "ёЁ" for c in seq):
        return -1.0  # plain Russian letters stand for themselves
    # letters of another script count in company only: one or two come out of correct text by chance
    blocks = [_block(c) if k == "script" else "" for c, k in zip(plain, kinds)]
    kinds = ["other" if k == "script" and (blocks.count(x) < 3 or len(set(kinds[max(0, i - 1) : i + 2]) & {"latin", "cyrillic", "latin2"})) else k for i, (k, x) in enumerate(zip(kinds, blocks))]
    gain = 0.0
    i = 0
    for c, k in zip(plain, kinds):
        n = len(c.encode())
        part = seq[i : i + n]
        left = seq[i - 1] if i else before
        right = seq[i + n] if i + n < len(seq) else after
        i += n
        if k == "other":
            gain -= 0.5
            continue
        if n >= 3:
            gain += 2.0 if k in ("east", "sign", "latin") else 1.0
            continue
        lead, tail = part[0], part[1]
        if k in ("c1", "inner"):
            gain += 0.3  # half of a nested layer
        elif k == "latin2":
            # a capital of another code page: only a nested layer makes it
            gain += 0.5 if not tail.isalpha() and tail not in "’”“‘»« ─│┐┘" else 0.3
        elif k in ("cyrillic", "script"):
            gain += 0.55
        elif lead.isupper() and tail in " ”’“‘»«…–—•™.°ºª":
            # a capital and closing punctuation: natural at the end of an upper-case word or of a sentence
            natural = left.isupper() or not left or left.isspace() and _kind(lead) == "cyrillic"
            gain += 0.3 if natural else 1.0
        elif lead.isalpha() and tail.isalpha() and _kind(lead) == _kind(tail) == "cyrillic":
            # two Cyrillic letters for one: unnatural inside a word of Latin letters
            gain += 1.0 if (left.isascii() and left.isalpha()) or (right.isascii() and right.isalpha()) else 0.55
        elif lead in "–—“”‘’" and name == "mac_roman":
            gain += 0.3
        else:
            gain += 1.0
    return gain


@lru_cache(maxsize=100_000)
def _reading(seq: str, name: str, before: str, after: str) -> tuple[float, str]:
    """Gain and text of a sequence read as UTF-8 under an encoding; no gain where it isn't well-formed.

    What comes out may be garbled itself: the gain is that of all its layers.
    """
    back, _ = _tables(name)
    try:
        plain = bytes(back[c] for c in seq).decode("utf-8")
    except UnicodeDecodeError:
        return -1.0, seq
    gain = _evidence(seq, plain, name, before, after)
    if len(plain) > 1 and gain > 0:
        gain += max((g for _, g, _ in _run_hits(plain, before, after)), default=0.0)
    return gain, plain


@lru_cache(maxsize=200_000)
def _run_hits(run: str, before: str, after: str) -> tuple[tuple[str, float, tuple[tuple[int, int, str], ...]], ...]:
    """By encoding: the gain of a run of odd characters, and its sequences with what they are read as."""
    out = []
    for name in READ_AS:
        hits, total = [], 0.0
        for m in _sequence(name).finditer(run):
            g, plain = _reading(m[0], name, run[m.start() - 1] if m.start() else before, run[m.end()] if m.end() < len(run) else after)
            if g > 0:
                hits.append((m.start(), m.end(), plain))
                total += g
        if hits:
            out.append((name, total, tuple(hits)))
    return tuple(out)


@lru_cache(maxsize=100_000)
def _run_is_clean(run: str) -> bool:
    """No encoding gives a run of odd characters any gain, whatever stands beside it."""
    return not any(_run_hits(run, side, side) for side in ("a", ""))


def _utf8_layer(s: str) -> tuple[str, list[str]] | None:
    """One layer of UTF-8 read as a single-byte encoding, undone where that lowers the cost."""
    gains: dict[str, float] = {}
    found: dict[str, list] = {}
    for m in _RUN.finditer(s):
        for name, g, hits in _run_hits(m[0], s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]):
            gains[name] = gains.get(name, 0.0) + g
            found.setdefault(name, []).extend((m.start() + a, m.start() + e, plain) for a, e, plain in hits)
    name = max((n for n in READ_AS if n in gains), key=lambda n: round(gains[n], 6), default=None)
    if name is None or gains[name] < 1.0:
        return None
    out, at = [], 0
    for a, e, plain in sorted(found[name] + _companions(s, name, found[name])):
        out += [s[at:a], plain]
        at = e
    return "".join([*out, s[at:]]), [name.rstrip("+") + "<utf-8"]


def _companions(s: str, name: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further sequences, too short to be told alone, that are of a script the text was found to hold."""
    seen = {_block(c) for _, _, plain in hits for c in plain if _kind(c) == "script"}
    if not seen:
        return []
    taken, back, out = {a for a, _, _ in hits}, _tables(name)[0], []
    for m in _RUN.finditer(s):
        for q in _sequence(name).finditer(m[0]):
            a = m.start() + q.start()
            if a not in taken:
                try:
                    plain = bytes(back[c] for c in q[0]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if all(_block(c) in seen for c in plain):
                    out.append((a, m.start() + q.end(), plain))
    return out


@lru_cache(maxsize=100_000)
def _is_utf8(run: str) -> bool:
    """The whole run is one reading of UTF-8."""
    return any(_sequence(n).fullmatch(run) and _reading(run, n, "", "")[0] > 0 for n in READ_AS)


# --- Japanese double-byte text read as a single-byte encoding ----------------------------------------------------

_EAST = [("latin-1", "cp932"), ("cp1252+", "cp932"), ("latin-1", "euc_jp"), ("cp1252+", "euc_jp"), ("mac_roman", "cp932"), ("cp1251+", "cp932"), ("cp437", "cp932"), ("cp850", "cp932"), ("koi8-r", "euc_jp"), ("mac_roman", "euc_jp")]
#: Text without white space, to which a double-byte passage is narrowed; its second bytes may be ASCII.
_TOKEN = re.compile(r"[^ \t\r\n]+")


_EAST_GATE = re.compile("[\x80-\x84\x86-\x9f]|[ƒ‚][^\\s]|¤[^\x00-\x7f]|[ГВ][^\x00-\x7fА-я]|âĹ")


def _east_layer(s: str) -> tuple[str, list[str]] | None:
    if not _EAST_GATE.search(s):
        return None
    tokens = [m for m in _TOKEN.finditer(s) if not m[0].isascii() and sum(c > "\x7f" for c in m[0]) >= 4]
    best = None
    for read, real in _EAST:
        back, _ = _tables(read)
        hits, gain = [], 0
        for m in tokens:
            t = m[0]
            if any(c > "\x7f" and c not in back for c in t):
                continue
            try:
                plain = bytes(back[c] if c > "\x7f" else ord(c) for c in t).decode(real)
            except UnicodeDecodeError:
                continue
            ka = sum("぀" <= c <= "ヿ" for c in plain)
            ea = sum(_kind(c) == "east" for c in plain)
            rest = sum(c > "\x7f" for c in plain) - ea
            half = sum("｡" <= c <= "ﾟ" for c in plain)
            if ka and ea - half >= 3 and rest + half <= ea // 4:
                hits.append((m.start(), m.end(), plain))
                gain += ea
        if gain >= 3 and (best is None or gain > best[0]):
            best = (gain, f"{read.rstrip('+')}<{real}", hits)
    if best is None:
        return None
    out, at = [], 0
    for a, e, plain in best[2]:
        out += [s[at:a], plain]
        at = e
    return "".join([*out, s[at:]]), [best[1]]


# --- one Cyrillic code page read as another ----------------------------------------------------------------------

#: Letters of Russian in order of frequency; the rank gives a rough likelihood.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ"
_RANK = {c: math.log(1.0 / (i + 3)) for i, c in enumerate(_RUSSIAN)}
#: Letters of other Cyrillic alphabets: rarer than any of these.
_RANK |= {c: math.log(1.0 / 30) for c in "іїєґў"}
#: Letters of Greek in the same way.
_GREEK = "αοιετσνηυρπκμλςωδγχθφβξζψάίόέήώύϊϋΐΰ"
_GREEK_RANK = {c: math.log(1.0 / (i + 3)) for i, c in enumerate(_GREEK)}
_PAGES = ["cp1251+", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5"]
_GREEK_PAGES = ["cp1253+", "iso8859-7"]
_CYR_READ = [*_PAGES, "latin-1", "cp1252+", "mac_roman", "cp437", "cp850"]
_HIGH_WORD = re.compile("[^\x00-\x7f]+")


#: A reading whose gain is so near to the best one's leaves it in doubt.
CLOSE = 0.97


def _likeness(words: list[str], ranks: dict[str, float]) -> float:
    """Mean log likelihood of letters of an alphabet and of their case, per character."""
    total, n = 0.0, 0
    for w in words:
        for i, c in enumerate(w):
            low = c.lower()
            n += 1
            total += ranks.get(low, -7.0)
            if c != low and i and not (w[i - 1].isupper() and w[0].isupper()):
                total -= 2.0
        if len(w) > 1 and w[0] != w[0].lower() and w[1:] == w[1:].upper() and any(c.isalpha() for c in w[1:]):
            total -= 0.4 * len(w)
    return total / max(n, 1)


#: Inverted case, or runs that are no words: without one of these no Cyrillic page was taken for another.
_CYR_GATE = re.compile("[а-яё][А-ЯЁ]|[À-ÿ]{4}|[А-яЁё][^\x00-\x7fА-яЁё\u0300-\u036f’“”«»…–—\xa0•№°]|[─-▟]{2}[^\x00-\x7f─-▟]|[Ѐ-џ][ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЄЇІіјЅѕї]")


def _swap_words(s: str, read: str, real: str) -> tuple[list[tuple[int, int, str]], list[str], list[str]]:
    """Words that read as Cyrillic or Greek of page ``real`` taken for ``read``: their places and readings, as they are, and as read."""
    back, (_, to) = _tables(read)[0], _tables(real)
    own, greek = read in _PAGES, real in _GREEK_PAGES
    hits, was, now = [], [], []
    for m in _HIGH_WORD.finditer(s):
        w = m[0]
        if not all(c in back and back[c] in to for c in w):
            continue
        # a word of Latin letters on either side is no Cyrillic word
        l, r = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
        if (l.isascii() and l.isalpha()) or (r.isascii() and r.isalpha()):
            continue
        plain = "".join(to[back[c]] for c in w)
        letters = _GREEK_RANK if greek else _RANK
        if not all(c.lower() in letters for c in plain):
            continue
        if _is_utf8(w):
            continue
        if own and w == w.lower() and plain == plain.upper() and all(c in _RANK for c in w):
            continue  # a plain small word becomes no capitals
        if _likeness([plain], letters) <= _likeness([w], _RANK) + (0.0 if own else -9.0):
            continue
        hits.append((m.start(), m.end(), plain))
        was.append(w)
        now.append(plain)
    return hits, was, now


def _cyrillic_layer(s: str) -> tuple[str, list[str]] | None:
    if not _CYR_GATE.search(s):
        return None
    best, second = None, 0.0
    for read in _CYR_READ:
        for real in _PAGES if read in _PAGES else [*_PAGES, *_GREEK_PAGES]:
            if real == read:
                continue
            hits, was, now = _swap_words(s, read, real)
            n, longest = sum(map(len, was)), max(map(len, was), default=0)
            if n < 6 or longest < 4 or (read not in _PAGES and n < 8):
                continue
            like = _likeness(now, _GREEK_RANK if real in _GREEK_PAGES else _RANK)
            gain = (like - _likeness(was, _RANK)) * n
            if gain < 0.9 * n or like <= -2.95:
                continue
            name = f"{read.rstrip('+')}<{real.rstrip('+')}"
            if best is None or gain > best[0]:
                if best is not None and best[2] != hits:
                    second = max(second, best[0])
                best = (gain, name, hits)
            elif hits != best[2]:
                second = max(second, gain)
    if best is None:
        return None
    out, at = [], 0
    for a, e, plain in best[2]:
        out += [s[at:a], plain]
        at = e
    return "".join([*out, s[at:]]), [best[1] + ("?" if second > CLOSE * best[0] else "")]


# --- one Western code page read as another -----------------------------------------------------------------------

_WEST = [("mac_roman", "cp1252"), ("cp1252+", "mac_roman"), ("latin-1", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252+", "cp437"), ("cp1252+", "cp850"), ("latin-1", "cp850"), ("latin-1", "cp437"), ("cp1250+", "cp1252"), ("cp1251+", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1253+", "cp1252"), ("cp1257+", "cp1252"), ("iso8859-2", "cp1252"), ("mac_roman", "cp850"), ("cp850", "mac_roman"), ("cp852", "cp1252"), ("latin-1", "cp1252")]
_WORD = re.compile(r"[^\s\x00-\x40\[-`{-\x7f]+")
#: Lower-case letters with marks that Portuguese, Spanish, French and German use.
_USUAL = set("áéíóúàèìòùâêîôûãõçñäöüßœæëïÿ")
#: Signs that stand between letters in correct text.
_JOINS = set("’‘­·​‌‍ʼ⁠﻿") | {chr(c) for c in range(0x300, 0x370)}


def _anomalies(w: str) -> int:
    """Places of a word that correct text doesn't have: a sign between letters, a marked capital after a small
    letter, scripts or code pages mixed."""
    n = 0
    ascii_letters = any(c.isascii() and c.isalpha() for c in w)
    for i, c in enumerate(w):
        if c.isascii():
            continue
        left, right = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        k = _kind(c)
        if 0x80 <= ord(c) < 0xA0:
            n += 1
        elif c.isupper() and k in ("latin", "latin2"):
            n += left.islower() or (left.isupper() and right.islower() and len(w) > 2 and any(x.islower() for x in w[:i]))
        elif k in ("cyrillic", "inner", "other", "latin2") or (c.isalpha() and k == "sign" and c not in "ªºµ"):
            n += ascii_letters
        elif not c.isalpha() and c not in _JOINS:
            n += left.isalpha() and right.isalpha() and left.isascii() | (left in _USUAL) and right.isascii() | (right in _USUAL)
    return n


_WEST_FINE = "áéíóúàèìòùâêîôûãõçñäöüßœæëïÿ" + "".join(re.escape(c) for c in sorted(_JOINS)) + "’“”…–—\xa0•«»°ºª€™©®¿¡§"
_WEST_GATE = re.compile(
    f"[a-z][À-ÖØ-Þ]|[A-Za-z][^\x00-\x7fÀ-ÖØ-Þ{_WEST_FINE}\u3000-\uffff\U00010000-\U0010ffff]|[^\x00-\x7fÀ-ÖØ-ÞŒŁŠŽ{_WEST_FINE}µ√½\u3000-\uffff\U00010000-\U0010ffff][a-z]"
)


def _west_layer(s: str) -> tuple[str, list[str]] | None:
    if not _WEST_GATE.search(s):
        return None
    words = [m for m in _WORD.finditer(s) if not m[0].isascii()]
    bad = [m for m in words if _anomalies(m[0])]
    if not bad:
        return None
    best = None
    for read, real in _WEST:
        back, _ = _tables(read)
        _, to = _tables(real)
        gain, fixed = 0, 0
        for m in bad:
            w = m[0]
            if not all(c.isascii() or (c in back and back[c] in to) for c in w):
                continue
            plain = "".join(c if c.isascii() else to[back[c]] for c in w)
            if not _anomalies(plain) and all(c.isascii() or c.lower() in _USUAL or c in "’“”–—…" for c in plain) and any(c.lower() in _USUAL for c in plain):
                gain += _anomalies(w)
                fixed += 1
        # a passage breaks several words; one alone may be a name spelled by choice
        if fixed and (gain >= 2 or fixed == len(bad) == 1 and len(bad[0][0]) >= 4) and (best is None or fixed > best[0]):
            best = (fixed, read, real)
    if best is None:
        return None
    _, read, real = best
    back, _ = _tables(read)
    _, to = _tables(real)
    out, at = [], 0
    for m in words:
        w = m[0]
        if all(c.isascii() or (c in back and back[c] in to) for c in w):
            plain = "".join(c if c.isascii() else to[back[c]] for c in w)
            ok = all(c.isascii() or c.lower() in _USUAL or c in "’“”–—…•" for c in plain) and not _anomalies(plain)
            if ok and (_anomalies(w) or any(c > "\x7f" and c.lower() not in _USUAL for c in w) or any(c.isupper() and c > "\x7f" for c in w)):
                out += [s[at : m.start()], plain]
                at = m.end()
    return "".join([*out, s[at:]]), [f"{read.rstrip('+')}<{real}"]


@lru_cache(maxsize=200_000)
def _context_is_clean(c: str) -> bool:
    """Nothing in a run of odd characters and its neighbours hints at damage; most texts end here."""
    if "�" in c or _C1.search(c) or _WEST_GATE.search(c) or _CYR_GATE.search(c) or _EAST_GATE.search(c):
        return False
    run = c.strip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    return len(run) < 2 or _run_is_clean(run)


def _restore(s: str) -> tuple[str, list[str]]:
    """A passage without its layers, and what was undone, outermost first."""
    done: list[str] = []
    seen = {s}
    while True:
        step = _east_layer(s) or _cyrillic_layer(s) or _utf8_layer(s) or _west_layer(s)
        # every layer lowers the cost; should two ever undo each other, the first text that comes back ends it
        if step is None or step[0] in seen:
            return s, done
        s = step[0]
        seen.add(s)
        done += step[1]


def _sound(s: str) -> bool:
    """Nothing is lost and no word is left that correct text doesn't have: marks of damage, or scripts mixed in one word."""
    if "\ufffd" in s or _C1.search(s):
        return False
    for m in _WORD.finditer(s):
        w = m[0]
        if not w.isascii() and (_anomalies(w) or len({"CYRILLIC", "GREEK", "LATIN"} & {_block(c) for c in w if c.isalpha() and c not in "ªºµ"}) > 1):
            return False
    return True


def repair(text: str | None) -> tuple[bool, str | None, list[str], bool]:
    """(is a case, text with all that can be restored, layers undone, whether it is whole again).

    Whole is said only of a text that shows no damage any more and whose readings were clearly better than any other;
    a layer whose reading was close to another one's ends with a question mark.
    """
    if not text or text.isascii():
        return False, text, [], True
    if all(map(_context_is_clean, set(_CONTEXT.findall(text)))):
        return False, text, [], True
    parts, at = [], 0
    for m in _ILLUSTRATION.finditer(text):
        parts += [(text[at : m.start()], True), (m[0], False)]
        at = m.end()
    parts.append((text[at:], True))
    # passages around illustrations are judged together: the mark keeps them apart
    mark = "\x00"
    whole, layers = _restore(mark.join(p for p, own in parts if own))
    own = iter(whole.split(mark)) if whole.count(mark) == sum(o for _, o in parts) - 1 else None
    out = "".join(next(own) if o else p for p, o in parts) if own else text
    lost = "�" in whole or bool(_C1.search(whole))
    return bool(layers) or lost, out, layers, _sound(whole) and not any(x.endswith("?") for x in layers)


_SCHEMA = "layers array<string>, whole boolean, restored string"


def _repair_batches(key: str):
    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            hit, layers, whole, out = [], [], [], []
            for i, t in enumerate(texts):
                case, fixed, ls, ok = repair(t)
                if case:
                    hit.append(i)
                    layers.append(ls)
                    whole.append(ok)
                    out.append(fixed)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(hit, pa.int64())), pa.array(layers, pa.list_(pa.string())), pa.array(whole, pa.bool_()), pa.array(out, pa.string())],
                names=[key, "layers", "whole", "restored"],
            )

    return run


def repair_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The damaged rows of ``docs``: key, layers undone, whether all was restored, and the restored text.

    Null, empty and plain ASCII texts are no case. A narrow pass: nothing is shuffled; texts without two odd
    characters together, or one beside a letter, are left behind in the scan.
    """
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key), F.col(text)).where(F.col(text).rlike("[^\\x00-\\x7f]"))
    return src.mapInArrow(_repair_batches(key), f"{key} {kind}, {_SCHEMA}")


def p8_repaired(spark, folder: str) -> DataFrame:
    return repair_garbled(table(spark, folder, "documents"))


def p8_found(spark, folder: str) -> DataFrame:
    return p8_repaired(spark, folder).select("doc_id").distinct()
