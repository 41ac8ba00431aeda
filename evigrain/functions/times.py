"""Time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrain.sources.tables import BLANKS

#: An ISO date, or a date-time with T or a space between: date, time without seconds, seconds, offset.
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2})?)(:\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def iso_instant(c: Column | str) -> Column:
    """The instant an ISO text names, in UTC where it has no offset; null for anything else, or if no such date exists."""
    t = F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    part = lambda k: F.regexp_extract(t, _ISO, k)
    hours = F.when(part(2) == "", "00:00").when(F.length(part(2)) == 2, F.concat(part(2), F.lit(":00"))).otherwise(part(2))
    seconds = F.when(part(3) == "", ":00").otherwise(part(3))
    digits = F.regexp_replace(part(4), ":", "")
    offset = F.when(digits.isin("", "Z"), "Z").otherwise(
        F.concat(F.substring(digits, 1, 3), F.lit(":"), F.when(F.length(digits) == 5, F.substring(digits, 4, 2)).otherwise("00"))
    )
    return F.when(t.rlike(_ISO), F.concat(part(1), F.lit("T"), hours, seconds, offset)).try_cast("timestamp")
