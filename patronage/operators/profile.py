"""Table profiles: missing values, summaries, and the data behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.joins import null_safe_join
from patronage.operators.ranking import exact_quantiles
from patronage.session import durable

QUARTERS = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTER_NAMES = ("min", "q1", "median", "q3", "max")


def null_census(df: DataFrame) -> DataFrame:
    """Missing values per column, as (column, missing) rows, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing")


def missing_share(df: DataFrame) -> DataFrame:
    """The share of missing values per column, as (column, share) rows, from one pass."""
    share = [F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), F.count(F.lit(1))).alias(c) for c in df.columns]
    return df.agg(*share).unpivot([], df.columns, "column", "share")


def null_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing columns; a pattern has a 1 for each missing column, in order."""
    flags = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, measure, value) rows with extremes, quartiles, mean and missing count."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    # The rows are read once: everything comes from how often a column has each value, null included.
    counted = durable(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    quantiles = exact_quantiles(counted, "value", QUARTERS, ["column"], weight="n").withColumnsRenamed(
        {f"p{i}": name for i, name in enumerate(QUARTER_NAMES)}
    )
    weight = F.col("n")
    rest = counted.groupBy("column").agg(
        (F.sum(F.col("value") * weight) / F.sum(F.when(F.col("value").isNotNull(), weight))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), weight)), F.lit(0)).cast("double").alias("missing"),
    )
    wide = null_safe_join(rest, quantiles, ["column"])
    return wide.unpivot(["column"], [*QUARTER_NAMES, "mean", "missing"], "measure", "value")


def schema_peek(df: DataFrame) -> DataFrame:
    """(column, type, sample, rows) per column; the sample is the least value as text."""
    least = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(c).cast("string").alias(c) for c in df.columns],
    )
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return least.unpivot(["rows"], df.columns, "column", "sample").select(
        "column", types[F.col("column")].alias("type"), "sample", "rows"
    )


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: quartiles, whiskers within 1.5 interquartile ranges, and rows outside them."""
    data = df.select(group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    boxes = exact_quantiles(data, "_v", QUARTERS[1:4], [group]).withColumnsRenamed(
        {"p0": "q1", "p1": "median", "p2": "q3"}
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return (
        null_safe_join(data, durable(boxes), [group])
        .groupBy(group)
        .agg(
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) rows over equally wide bins from the least to the greatest value; empty bins left out."""
    value = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    data = df.select(value.alias("_v"), edges.alias("_e")).where(F.col("_v").isNotNull())
    low, high = F.col("_e.low"), F.col("_e.high")
    place = F.floor(F.try_divide((F.col("_v") - low) * bins, high - low))
    slot = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return data.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
