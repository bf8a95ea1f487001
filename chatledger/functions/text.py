"""Text conversions with the exact acceptance rules of the command surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings read as true; any other text is false.
TRUE_SPELLINGS = ("1", "t", "T", "true", "TRUE", "True")


def to_flag(text: Column) -> Column:
    """A flag from text; bad or missing text is false."""
    return F.coalesce(text.isin(*TRUE_SPELLINGS), F.lit(False))


def to_id(text: Column) -> Column:
    """A 64-bit id from text, null unless it is an optional sign and digits within range."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def joined_ids(ids: Column) -> Column:
    """An id list as comma-joined text."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
