"""Filling missing values and lumping rare ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.labels import OTHERS, RARE_NATIONALITY_LIMIT
from patronage.functions.missing import if_else
from patronage.operators.aggregate import frequency
from patronage.operators.joins import attach_group_stats, null_safe_join, prefer
from patronage.operators.ranking import top_n_per_group
from patronage.session import durable


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls replaced by a constant per column."""
    return df.fillna(dict(values))


def fill_by_map(df: DataFrame, column: str, by: str, mapping: Mapping) -> DataFrame:
    """Nulls of ``column`` replaced by the value listed for ``by``; unlisted stay null."""
    choice = F.when(F.col(column).isNotNull(), F.col(column))
    for key, value in mapping.items():
        choice = choice.when(F.col(by) == key, F.lit(value))
    kind = df.schema[column].dataType
    return df.withColumn(column, choice.cast(kind))


def group_mode(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """The most frequent known value of each group, with its count; ties are all kept."""
    counts = durable(frequency(df.where(F.col(column).isNotNull()), *groups, column))
    return top_n_per_group(counts, "n", groups)


def fill_by_group_mode(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Nulls replaced by the group's most frequent value, the smallest one on ties."""
    modes = group_mode(df, groups, column).groupBy(*groups).agg(F.min(column).alias("_mode"))
    return prefer(null_safe_join(df, durable(modes), groups), column, "_mode")


def fill_with_max(df: DataFrame, column: str) -> DataFrame:
    """Nulls replaced by the column's greatest value."""
    return df.withColumn(column, F.coalesce(F.col(column), df.agg(F.max(column)).scalar()))


def lump_rare(
    df: DataFrame, column: str, name: str, limit: int = RARE_NATIONALITY_LIMIT, label: str = OTHERS
) -> DataFrame:
    """Values on fewer than ``limit`` rows become ``label``; the row count is kept as ``n_<column>``."""
    counted = attach_group_stats(df, [column], {f"n_{column}": F.count(F.lit(1))})
    rare = F.col(f"n_{column}") < limit
    return counted.withColumn(name, if_else(rare, F.lit(label), F.col(column)))
