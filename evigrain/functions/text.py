"""Text functions as column expressions: tokens, light stems, token estimates, digests. No Python in the plan.

Null texts behave as empty ones. Letters and digits are those of Unicode; combining marks part tokens.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions import fixed

#: Unicode white space, spelled out: the regular expressions of the JVM know ASCII only.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TOKEN = "[\\p{L}\\p{N}_]+"
_SIGNED_TOKEN = "-?[\\p{L}\\p{N}_]+(?:[.-][\\p{L}\\p{N}_]+)*"
_COUNTED = f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{SPACE}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: list[str]) -> Column:
    """An array literal."""
    return F.array(*[F.lit(v) for v in values])


def fold(c: Column | str) -> Column:
    """Lower case with ß as ss and the final sigma as any other."""
    return F.replace(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def term_list(c: Column | str) -> Column:
    """Distinct folded tokens of more than one character, in order of first occurrence."""
    found = F.filter(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(_TOKEN), F.lit(0)), lambda t: F.length(t) > 1)
    return F.array_distinct(F.transform(found, fold))


def forms_of(tokens: Column | str) -> Column:
    """Distinct tokens with their light stems: -ing (also as -e), -ed, -es (both ways), other -s, -er; more than one character."""

    def stems(t: Column) -> Column:
        n = F.length(t)
        cut = lambda k: F.substring(t, F.lit(1), n - k)
        es = (n > 4) & F.endswith(t, F.lit("es"))
        when = lambda suffix, value: F.when((n > 4) & F.endswith(t, F.lit(suffix)), value)
        found = F.array(
            t, when("ing", cut(3)), when("ing", F.concat(cut(3), F.lit("e"))), when("ed", cut(2)), F.when(es, cut(1)), F.when(es, cut(2)),
            F.when(~es & (n > 3) & F.endswith(t, F.lit("s")), cut(1)), when("er", cut(2)),
        )
        return F.filter(found, lambda x: F.length(x) > 1)

    return F.array_distinct(F.flatten(F.transform(col(tokens), stems)))


def lexical_forms(c: Column | str) -> Column:
    """Tokens of a text with their light stems."""
    return forms_of(term_list(c))


def unit_text(label: str = "label", summary: str = "summary", content: str = "content") -> Column:
    """The text by which a unit is found: label, summary and content."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (label, summary, content)])


def unit_forms(units: DataFrame) -> Column:
    """The forms of a unit's text, as they are written beside it or worked out."""
    return F.col("forms") if "forms" in units.columns else lexical_forms(unit_text())


def signed_tokens(c: Column | str) -> Column:
    """Tokens of a query with the parts joined by . or - kept together and a leading - left on."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(_SIGNED_TOKEN), F.lit(0))


def token_estimate(c: Column | str) -> Column:
    """Runs of word characters and single other characters, white space left out."""
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(_COUNTED), F.lit(0)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    either = F.size(col(a)) + F.size(col(b)) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def digest(c: Column | str) -> Column:
    """SHA-256 of the UTF-8 text, in hex; a null text as an empty one."""
    return F.sha2(F.coalesce(col(c), F.lit("")), 256)


def eol_digest(c: Column | str) -> Column:
    """Digest of a text whose line ends are all made CR LF first."""
    return digest(F.replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n"), F.lit("\n"), F.lit("\r\n")))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that are a letter with marks, the letters, and at the end the marks themselves."""
    pairs, marks = {}, []
    for o in range(0x80, 0xFB50):
        c = chr(o)
        if 0xAC00 <= o <= 0xDFFF:
            continue
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        bare = [x for x in parts if unicodedata.category(x)[0] != "M"]
        if len(parts) > 1 and len(bare) == 1:
            pairs[c] = bare[0]
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


def index_tokens(c: Column | str) -> Column:
    """Tokens of the full-text index in order, repeated ones kept: lower case, without marks, parted at underscores."""
    bare = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), *_accents())
    return F.regexp_extract_all(bare, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def render(unit: str = "unit_id", label: str = "label", content: str = "content", location: str = "source_location", source: str = "source_id", confidence: str = "confidence") -> Column:
    """A unit as it stands in a context, with its citation."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in (unit, label, content, location, source)]
    return F.format_string(fixed.UNIT_FORMAT, *text, F.coalesce(F.col(confidence), F.lit(1.0)))
