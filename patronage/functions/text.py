"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions.missing import as_text


def shorten(column: Column, width: int = 10) -> Column:
    """Strings longer than ``width`` keep their first ``width - 3`` characters and end in ``...``.

    Distinct ids with the same leading characters become equal; group by the full id where that matters.
    """
    return F.when(
        F.length(column) > width, F.concat(F.substring(column, 1, width - 3), F.lit("..."))
    ).otherwise(column)


def without(column: Column, pattern: str) -> Column:
    """Every match of the regular expression removed."""
    return F.regexp_replace(column, pattern, "")


def piece(column: Column, separator: str, index: int) -> Column:
    """The ``index``-th part (from 0) of a separated string, null if there is no such part."""
    return F.get(F.split(column, separator), F.lit(index))


def glue(separator: str, *columns: Column) -> Column:
    """Values joined into one text, nulls printed as ``NA``."""
    return F.concat_ws(separator, *[as_text(c) for c in columns])


def digits_code(*columns: Column) -> Column:
    """Digits written side by side and read as one number; null if any digit is null."""
    return F.concat(*[c.cast("string") for c in columns]).cast("int")
