"""Equal-sized tiles without sorting the rows: the rows at the cut ranks are selected, then one projection tiles all.

All cuts of all measures are narrowed together. A pass counts the rows per cut and bin of the range in which the cut
still lies; the bin that holds the cut's rank is the next range. If the bin is a single value, its ties are narrowed
on the key in the same way, so a value held by a third of all rows is never gathered; if few rows are left in it,
they are fetched and the row is picked. What reaches the driver is bounded by the bins per cut and ``FEW`` rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 1024
FEW = 512


class NotSelectable(Exception):
    """The values cannot be narrowed as numbers; a sort has to place the rows."""


@dataclasses.dataclass
class Cut:
    """The ``rank``-th row of a measure in order; while ``value`` is open the range is of the measure, then of the key."""

    measure: str
    descending: bool
    rank: int
    low: float
    high: float
    rows: int
    value: Any = None
    key: Any = None
    tied: bool = False

    @property
    def is_found(self) -> bool:
        return self.key is not None

    def place(self, key: str) -> Column:
        """The number that is narrowed, rising in the order of the rows."""
        if self.tied:
            return F.col(key).cast("double")
        x = F.col(self.measure).cast("double")
        return -x if self.descending else x

    def inside(self, key: str) -> Column:
        x = self.place(key)
        here = (x >= F.lit(self.low)) & (x <= F.lit(self.high))
        return here & (F.col(self.measure) == F.lit(self.value)) if self.tied else here


def _narrow(df: DataFrame, cuts: list[Cut], key: str) -> None:
    """One pass: each cut's range becomes the bin that holds its rank."""
    marks = []
    for i, cut in enumerate(cuts):
        x = cut.place(key)
        width = cut.high - cut.low
        bin_ = F.least(F.lit(BINS - 1), F.floor((x - F.lit(cut.low)) / F.lit(width) * BINS)) if width > 0 else F.lit(0)
        mark = F.struct(
            F.lit(i).alias("cut"),
            bin_.cast("int").alias("bin"),
            x.alias("x"),
            F.col(key).cast("double").alias("key"),
        )
        marks.append(F.when(cut.inside(key), mark))
    one = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")
    found = one.groupBy("cut", "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.min("key").alias("low_key"),
        F.max("key").alias("high_key"),
    )
    bins: dict[int, list] = {i: [] for i in range(len(cuts))}
    for row in found.collect():
        bins[row.cut].append(row)
    for i, cut in enumerate(cuts):
        for row in sorted(bins[i], key=lambda r: r.bin):
            if cut.rank <= row.rows:
                break
            cut.rank -= row.rows
        same = row.rows == cut.rows and (row.low, row.high) == (cut.low, cut.high)
        cut.low, cut.high, cut.rows = row.low, row.high, row.rows
        if cut.rows > FEW and cut.low == cut.high:
            if cut.tied:
                raise NotSelectable(f"{cut.rows} rows share a value of {cut.measure} and {key}")
            cut.value = _single(df, cut, key)
            cut.tied, cut.low, cut.high = True, row.low_key, row.high_key
        elif same and cut.rows > FEW:
            raise NotSelectable(f"{cut.measure} cannot be told apart as numbers")


def _single(df: DataFrame, cut: Cut, key: str) -> Any:
    ends = df.where(cut.inside(key)).agg(F.min(cut.measure), F.max(cut.measure)).first()
    if ends[0] != ends[1]:
        raise NotSelectable(f"values of {cut.measure} differ by less than a double holds")
    return ends[0]


def _pick(df: DataFrame, cuts: list[Cut], key: str) -> None:
    """Fetches the few rows left of each cut and takes the one at its rank."""
    marks = [F.when(cut.inside(key), F.lit(i)) for i, cut in enumerate(cuts)]
    measures = sorted({cut.measure for cut in cuts})
    left = df.select(key, *measures, F.explode(F.array_compact(F.array(*marks))).alias("_cut")).collect()
    for i, cut in enumerate(cuts):
        own = sorted((row for row in left if row["_cut"] == i), key=lambda r: r[key])
        own.sort(key=lambda r: r[cut.measure], reverse=cut.descending)
        cut.value, cut.key = own[cut.rank - 1][cut.measure], own[cut.rank - 1][key]


def _starts(df: DataFrame, measures: Mapping[str, tuple[str, bool]], key: str, tiles: int) -> dict[str, list[Cut]]:
    """The cuts of each tile column over the measure's whole range."""
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema)))
    for column in {key, *(m for m, _ in measures.values())}:
        if not isinstance(kinds[column], T.NumericType):
            raise NotSelectable(f"{column} is not a number")
    names = sorted({m for m, _ in measures.values()})
    parts = []
    for m in names:
        x = F.col(m).cast("double")
        odd = F.count(F.when(F.isnan(x) | (F.abs(x) == float("inf")), 1))
        parts += [F.count(m).alias(f"{m}_n"), F.min(x).alias(f"{m}_low"), F.max(x).alias(f"{m}_high"), odd.alias(f"{m}_odd")]
    ends = df.agg(F.count(F.when(F.col(key).isNull(), 1)).alias("_no_key"), *parts).first()
    if ends["_no_key"] or any(ends[f"{m}_odd"] for m in names):
        raise NotSelectable("rows without a key, or values that are no finite numbers")
    cuts: dict[str, list[Cut]] = {}
    for name, (m, descending) in measures.items():
        n, low, high = ends[f"{m}_n"], ends[f"{m}_low"], ends[f"{m}_high"]
        if descending and n:
            low, high = -high, -low
        size, extra = divmod(n, tiles)
        through = [size * t + min(t, extra) for t in range(1, tiles)]
        # a tile that starts after the last row has no cut
        cuts[name] = [Cut(m, descending, r, low, high, n) for r in through if 0 < r < n]
    return cuts


def select_tiles(
    df: DataFrame, measures: Mapping[str, tuple[str, bool]], key: str, tiles: int
) -> DataFrame:
    """Adds a tile column 1..``tiles`` for each of ``measures`` (name → measure, descending).

    Tiles are equal-sized, the first ``rows mod tiles`` of them one row larger; ties are ordered by the unique
    ``key``; a null measure gets no tile. ``df`` is read several times, so it should be a table. Measures and key
    must be numbers a double can tell apart, else ``NotSelectable`` is raised.
    """
    starts = _starts(df, measures, key, tiles)
    cuts = [cut for own in starts.values() for cut in own]
    while wide := [cut for cut in cuts if cut.rows > FEW]:
        _narrow(df, wide, key)
    if cuts:
        _pick(df, cuts, key)
    out = {}
    for name, (m, descending) in measures.items():
        tile = F.lit(1)
        for cut in starts[name]:
            value = F.lit(cut.value)
            beyond = F.col(m) < value if descending else F.col(m) > value
            tile = tile + F.when(beyond | ((F.col(m) == value) & (F.col(key) > F.lit(cut.key))), 1).otherwise(0)
        out[name] = F.when(F.col(m).isNotNull(), tile.cast("int"))
    return df.withColumns(out)
