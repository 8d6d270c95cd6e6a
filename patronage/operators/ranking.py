"""Exact global order without a single-task sort: positions, running totals, tiles, quantiles, top-n.

The rows are range-partitioned on the full sort key, so even a value held by a third of all rows is cut
at its tie-break key. Each partition numbers its own rows and adds the row count of the partitions before
it. The placed rows are made durable first, because a range partitioning sampled a second time may cut
elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.operators.joins import attach_group_stats, null_safe_join
from patronage.operators.tiles import NotSelectable, select_tiles
from patronage.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in these low bits


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range partitions in sort order, sized by AQE unless their number is given.

    AQE only merges neighbours, so partition numbers still follow the order.
    """
    return df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)


def _partition_starts(placed: DataFrame, amount: Column) -> DataFrame:
    """What lies before each partition. The window runs over one row per partition only."""
    sums = placed.groupBy("_part").agg(amount.alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))


def global_position(
    df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None
) -> DataFrame:
    """The row's 1-based position in the whole table. ``order`` must end in a unique key."""
    placed = durable(
        _ranged(df, order, partitions)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    starts = _partition_starts(placed, F.count(F.lit(1)))
    inside = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (inside + F.col("_start")).cast("long"))
        .drop("_row", "_part", "_start")
    )


def running_total(
    df: DataFrame, order: Sequence[Column], amount: str, name: str, partitions: int | None = None
) -> DataFrame:
    """The sum of ``amount`` from the first row of the whole table up to and including this one."""
    placed = durable(_ranged(df, order, partitions).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn(name, F.sum(amount).over(inside))
        .join(F.broadcast(_partition_starts(placed, F.sum(amount))), "_part")
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_part", "_start")
    )


def exact_ntile(
    df: DataFrame,
    measure: str,
    key: str,
    tiles: int,
    name: str,
    descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Equal-sized tiles 1..``tiles`` by ``measure``, ties ordered by ``key``; a null measure gets none.

    The first ``rows mod tiles`` tiles hold one row more than the others.
    """
    return exact_ntiles(df, {name: (measure, descending)}, key, tiles, partitions)


def exact_ntiles(
    df: DataFrame,
    measures: Mapping[str, tuple[str, bool]],
    key: str,
    tiles: int,
    partitions: int | None = None,
) -> DataFrame:
    """Several tile columns (name → measure, descending), as in ``exact_ntile``.

    The cut rows of all of them are selected together and the rows tiled by comparison. Only values that cannot
    be narrowed as numbers (texts, dates, NaN, repeated keys among many ties) are placed by a sort per measure.
    """
    df = durable(df)
    try:
        return select_tiles(df, measures, key, tiles)
    except NotSelectable:
        for name, (measure, descending) in measures.items():
            df = _sorted_ntile(df, measure, key, tiles, name, descending, partitions)
        return df


def _sorted_ntile(
    df: DataFrame, measure: str, key: str, tiles: int, name: str, descending: bool, partitions: int | None
) -> DataFrame:
    column = F.col(measure)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    placed = global_position(df, [order, F.col(key).asc()], "_position", partitions)
    known = placed.agg(F.count(measure)).scalar()
    size, extra = F.floor(known / tiles), known % tiles
    rank = F.col("_position") - 1
    wide = extra * (size + 1)
    tile = F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(rank - wide, size))
    )
    return placed.withColumn(name, F.when(column.isNotNull(), (tile + 1).cast("int"))).drop(
        "_position"
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    partitions: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group, columns ``p0``, ``p1``, … in order.

    A row counts as often as ``weight`` says, once by default.

    Works on (group, value, count) rows, so equal values meet before the first shuffle, and finds each
    rank from running counts, so no task holds the values of a whole group.
    """
    groups = list(groups)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_count"))
    )
    order = [F.col(g).asc_nulls_first() for g in groups] + [F.col("_value").asc()]
    runs = running_total(counts, order, "_count", "_through", partitions)
    runs = runs.withColumn("_before", F.col("_through") - F.col("_count"))
    edges = {"_first": F.min("_before"), "_last": F.max("_through")}
    if groups:
        runs = attach_group_stats(runs, groups, edges)
    else:
        both = runs.agg(F.struct(*[e.alias(name) for name, e in edges.items()])).scalar()
        runs = runs.withColumn("_edges", both).select("*", "_edges.*")
    size = F.col("_last") - F.col("_first")

    def at(rank: Column) -> Column:
        place = F.col("_first") + rank
        return F.max(F.when((place >= F.col("_before")) & (place < F.col("_through")), F.col("_value")))

    picks = [F.max(size).alias("_size")]
    for i, p in enumerate(probabilities):
        rank = (size - 1) * F.lit(float(p))
        picks += [at(F.floor(rank)).alias(f"_low{i}"), at(F.ceil(rank)).alias(f"_high{i}")]
    picked = runs.groupBy(*groups).agg(*picks)
    out = []
    for i, p in enumerate(probabilities):
        rank = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(f"p{i}"))
    return picked.select(*groups, *out)


def top_n(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows largest in ``by``, with all rows tied to the last of them; ``df`` is read twice."""
    last = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by)).scalar()
    return df.where(F.col(by) >= last)


def group_cuts(df: DataFrame, by: str, groups: Sequence[str], n: int) -> DataFrame:
    """Per group the ``n``-th largest value of ``by`` as ``_cut``.

    At most ``n`` rows per group leave a map task (Spark limits the window before its shuffle), however
    many rows are tied.
    """
    if n == 1:
        return df.groupBy(*groups).agg(F.max(by).alias("_cut"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(by)))
    best = df.select(*groups, by).withColumn("_place", place).where(F.col("_place") <= n)
    return best.groupBy(*groups).agg(F.min(by).alias("_cut"))


def top_n_per_group(df: DataFrame, by: str, groups: Sequence[str], n: int = 1) -> DataFrame:
    """Per group the ``n`` rows largest in ``by``, with ties; ``df`` is read twice.

    The rows are only compared with their group's cut value, so ties never meet in one task.
    """
    cuts = durable(group_cuts(df, by, groups, n))
    return null_safe_join(df, cuts, groups, "inner").where(F.col(by) >= F.col("_cut")).drop("_cut")
