"""Column selection, casting and stacking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive(df: DataFrame, **expressions: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """Columns added one after the other, so that each may use those before it.

    Every step is a plain projection; Catalyst merges them into one.
    """
    for name, expression in expressions.items():
        df = df.withColumn(name, expression(df) if callable(expression) else expression)
    return df


def quoted(name: str) -> Column:
    """The column of exactly this name, also where the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def across(df: DataFrame, names: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """One change applied to every named column."""
    return df.withColumns({name: change(quoted(name)) for name in names})


def prefix_all_but(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, absent columns null, duplicates kept."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose flag is 1 and rows whose flag is 0."""
    return df.where(F.col(flag) == 1), df.where(F.col(flag) == 0)
