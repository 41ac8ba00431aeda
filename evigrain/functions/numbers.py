"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Less than what counts and more than the error of a sum.
SHIFT = 1.0005e-13


def r10(c: Column | str) -> Column:
    """Rounded to ten places, a tie up even where the last bits of a sum say otherwise."""
    return F.round((F.col(c) if isinstance(c, str) else c) + SHIFT, 10)


def exact_sum(c: Column | str) -> Column:
    """A sum that doesn't depend on the order of its terms, which are taken to sixteen places."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,16)")).cast("double")
