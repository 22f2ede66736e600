"""Array elements as terms: trimmed, lower-cased, without nulls and empties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(column: str | Column, distinct: bool = True) -> Column:
    """The terms of an array column; a null array has none (an empty array).

    Outer blanks and tabs go, letters become lower case; null elements and empty terms are left out.
    With ``distinct`` each term stands once, at its first place.
    """
    c = F.col(column) if isinstance(column, str) else column
    cleaned = F.filter(F.transform(c, lambda x: F.lower(F.btrim(x, F.lit(" \t")))), lambda x: x != "")
    cleaned = F.coalesce(cleaned, F.array().cast("array<string>"))
    return F.array_distinct(cleaned) if distinct else cleaned
