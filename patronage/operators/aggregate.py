"""Grouped aggregates. All of them combine before their shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.missing import strict


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_frequent_first(counts: DataFrame) -> DataFrame:
    """A frequency table sorted by falling count, then by its keys."""
    return counts.orderBy(F.desc("n"), *[c for c in counts.columns if c != "n"])


def grouped_sum(
    df: DataFrame, keys: Sequence[str], amount: Column, name: str, skip_missing: bool = False
) -> DataFrame:
    """Sum of an expression per group; without ``skip_missing`` one null makes the sum null."""
    total = F.sum(amount)
    return df.groupBy(*keys).agg((total if skip_missing else strict(total, amount)).alias(name))


def exact_mean(column: Column) -> Column:
    """Mean of a decimal column as a double; the decimal sum does not depend on row order."""
    return F.sum(column).cast("double") / F.count(column)


def target_encoding(df: DataFrame, keys: Sequence[str], target: str, prefix: str) -> DataFrame:
    """Per key combination: row count, and least, greatest and mean target, each divided by that count.

    Meant for training rows. A row's own target takes part in its encoding; that is how the features are
    defined. A group with an unknown target has only its count.
    """
    value = F.col(target)
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}_spent"),
        strict(F.min(value), value).cast("double").alias(f"{prefix}_min"),
        strict(F.max(value), value).cast("double").alias(f"{prefix}_max"),
        strict(exact_mean(value), value).alias(f"{prefix}_avg"),
    )
    return stats.withColumns(
        {f"{prefix}_{m}": F.col(f"{prefix}_{m}") / F.col(f"{prefix}_spent") for m in ("min", "max", "avg")}
    )
