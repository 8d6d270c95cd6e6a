"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the boosted trees, the search winner and the ridge model in the blend.
BLEND_WEIGHTS = (0.55, 0.40, 0.05)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double; null where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def row_mean(*columns: Column) -> Column:
    """Mean across columns, null if one of them is null."""
    return reduce(add, columns) / F.lit(float(len(columns)))


def blend(columns: Sequence[Column], weights: Sequence[float] = BLEND_WEIGHTS) -> Column:
    """Weighted sum of columns."""
    return reduce(add, [c * F.lit(w) for c, w in zip(columns, weights, strict=True)])
