"""Joins that match null to null, and group statistics attached to every row.

No join here is forced to broadcast. A table of group statistics is first made durable, so that Catalyst
knows its real size: below ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the rows it joins
are not shuffled at all; beyond it both sides are shuffled and AQE splits the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import durable


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on equally named keys in which null equals null; the left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share, null matching null."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no column name")
    return null_safe_join(left, right, shared)


def attach_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]
) -> DataFrame:
    """Group aggregates repeated on every row of the group.

    A window over the group would bring all its rows to one task. Here the aggregate combines before
    its shuffle, and only the one row per group is joined back.
    """
    table = df.groupBy(*keys).agg(*[e.alias(name) for name, e in stats.items()])
    return null_safe_join(df, durable(table), keys)


def join_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Facts with a match in the dimension, plus the named dimension columns.

    The dimension is often a join itself, whose size Catalyst can only guess, so it is made durable: a
    small one is then broadcast and the facts stay where they are.
    """
    return facts.join(durable(dimension.select(key, *columns)), key, "inner")


def share_of_group(df: DataFrame, value: str, groups: Sequence[str], name: str) -> DataFrame:
    """Each row's part of its group's total. ``df`` is computed once, though it is read twice."""
    df = durable(df)
    whole = attach_group_stats(df, groups, {"_whole": F.sum(value)})
    part = F.try_divide(F.col(value).cast("double"), F.col("_whole").cast("double"))
    return whole.withColumn(name, part).drop("_whole")


def prefer(df: DataFrame, column: str, fallback: str) -> DataFrame:
    """Nulls of ``column`` filled from ``fallback``, which is dropped."""
    return df.withColumn(column, F.coalesce(column, fallback)).drop(fallback)
