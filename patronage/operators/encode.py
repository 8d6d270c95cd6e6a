"""Categorical and numeric encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.ranking import global_position
from patronage.session import durable


def level_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, number): the levels of the text columns, each column's numbered from 0 in code-point order.

    The dictionary is a table on shared storage, made without any list in the driver, so a column may have as many
    levels as rows. Save it next to a model and give it to ``level_numbers`` for later rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    levels = df.select(F.explode(pairs).alias("_pair")).select("_pair.*").where("level is not null").distinct()
    placed = durable(global_position(levels, [F.col("column").asc(), F.col("level").asc()], "_place"))
    first = placed.groupBy("column").agg(F.min("_place").alias("_first"))
    numbered = placed.join(durable(first), "column")
    return durable(numbered.select("column", "level", (F.col("_place") - F.col("_first")).alias("number")))


def level_numbers(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's level numbers as ``<column>_index``: null gets the number after the last, an unknown level the next.

    A dictionary of known small size is broadcast by Catalyst; a large one meets the rows by level.
    """
    sizes = dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("column").isin(*columns))
    many = {row["column"]: row["n"] for row in sizes.collect()}
    for c in columns:
        own = dictionary.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("number").alias("_number"))
        df = df.join(own, F.col(c).cast("string") == F.col("_level"), "left")
        beyond = F.when(F.col(c).isNull(), F.lit(many.get(c, 0))).otherwise(F.lit(many.get(c, 0) + 1))
        df = df.withColumn(f"{c}_index", F.coalesce("_number", beyond).cast("long")).drop("_level", "_number")
    return df


def level_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each text column's level number in code-point order as ``<column>_index``; null gets the next number."""
    return level_numbers(df, level_dictionary(df, columns), columns)


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str, other: bool = False) -> DataFrame:
    """A 0/1 column per level, all levels kept; null where the value is null.

    A level that is not listed is 0 in all of them; with ``other`` the column ``<prefix>_other`` says so.
    """
    flags = {f"{prefix}_{i}": (F.col(column) == level).cast("int") for i, level in enumerate(levels)}
    if other:
        flags[f"{prefix}_other"] = (~F.col(column).isin(*levels)).cast("int")
    return df.withColumns(flags)


def range_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_range`` runs from 0 to 1; null for a constant column."""
    edges = df.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"{c}_low") for c in columns],
            *[F.max(F.col(c).cast("double")).alias(f"{c}_high") for c in columns],
        )
    ).scalar()
    df = df.withColumn("_edges", edges)
    for c in columns:
        low, high = F.col(f"_edges.{c}_low"), F.col(f"_edges.{c}_high")
        df = df.withColumn(f"{c}_range", F.try_divide(F.col(c).cast("double") - low, high - low))
    return df.drop("_edges")


def sd_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_sd`` is the value divided by the sample standard deviation, not centred."""
    spreads = df.agg(F.struct(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns])).scalar()
    df = df.withColumn("_spread", spreads)
    for c in columns:
        df = df.withColumn(f"{c}_sd", F.try_divide(F.col(c).cast("double"), F.col(f"_spread.{c}")))
    return df.drop("_spread")
