"""Token costs of texts that take a tokenizer; where it can't be had, the estimate stands in."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrain.functions.text import token_estimate

_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("cost", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str, pattern: str = _PATTERN) -> Callable[[Column], Column]:
    """A cost by a byte-pair vocabulary, a file of ranks that every executor can read; text that looks like a mark is text."""
    try:
        _encoding(path, pattern)
    except (ImportError, OSError, ValueError):
        return token_estimate

    @F.pandas_udf("int")
    def cost(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t or "")))

    return cost
