"""Expressions whose treatment of missing values differs from SQL's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TEXT = "NA"


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def not_among(column: Column, values: Iterable) -> Column:
    """True for values outside the list and for nulls (plain NOT IN would drop the nulls)."""
    return ~F.coalesce(column.isin(*values), F.lit(False))


def as_text(column: Column) -> Column:
    """The value as text, with a null printed as ``NA``."""
    return F.coalesce(column.cast("string"), F.lit(MISSING_TEXT))


def strict(aggregate: Column, column: Column) -> Column:
    """An aggregate that is null as soon as one of its inputs is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), aggregate)
