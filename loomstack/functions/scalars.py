"""Column builders used in several places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, as a Java character class.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def stripped(c: Column) -> Column:
    """Without leading and trailing Unicode white space; the cheap test keeps the regex off clean values."""
    return F.when(c.rlike(f"^{BLANK}|{BLANK}$"), F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")).otherwise(c)


def folded(c: Column) -> Column:
    """Trimmed and in lower case: the form in which identifiers are compared."""
    return F.lower(stripped(c))


def non_blank(c: Column) -> Column:
    """True for a text with at least one character that is not white space; false for null."""
    return F.coalesce(c.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(False))
