"""Delimited text with a header and ``NA`` for missing values.

A quoted field may hold line breaks, so where a row begins depends on all quotes before it. One scan counts the
quotes of each file split; their parity, summed over the splits ahead, tells which splits begin inside a field.
A second scan then cuts every split into rows by itself. Rows that lie in several splits are put together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from patronage.functions.missing import MISSING_TEXT
from patronage.operators.columns import across
from patronage.session import durable

ROWS_IN_FILE = 500_000
_SPLIT = ["_file", "_split"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The physical lines in the order of each split."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def _open_splits(lines: DataFrame) -> DataFrame:
    """The splits that begin inside quotes, as ``_file``, ``_split`` and ``_open`` = 1."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy(*_SPLIT).agg(F.bit_xor((quotes % 2).cast("int")).alias("_odd"))
    ahead = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = parity.select(*_SPLIT, (F.sum("_odd").over(ahead) % 2).cast("int").alias("_open"))
    return durable(carried.where("_open = 1"))


class _Cutter:
    """Cuts the lines of one split into rows; rows that begin before or end after it come out as pieces."""

    def __init__(self, file: str, split: int, is_open: int):
        self.place, self.parity, self.whole = (file, split), is_open, not is_open
        self.held: list[str] = []
        self.header = split == 0  # the first row of a file is its header

    def piece(self, kind: int) -> list[tuple]:
        """What is held as a piece: 0 goes on from before the split, 1 begins in it."""
        return [("\n".join(self.held), *self.place, kind, self.header)] if self.held else []

    def add(self, lines: pa.Array) -> tuple[pa.Array, list[tuple]]:
        """Rows of a single line, and (value, file, split, kind, header) of the others; kind None is a whole row."""
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        after = (self.parity + np.cumsum(odd)) & 1
        starts = np.flatnonzero(after == odd)  # no quote is open before these lines
        first = int(starts[0]) if len(starts) else len(lines)
        self.parity = int(after[-1])
        self.held += lines.slice(0, first).to_pylist()
        others = []
        if len(starts):
            if self.held:
                others += self.piece(0) if not self.whole else [("\n".join(self.held), None, None, None, self.header)]
                self.header = self.header and not self.whole
            self.held, self.whole = [], True
        ends = np.append(starts[1:], len(lines))
        if len(starts) and self.parity:
            self.held = lines.slice(int(starts[-1])).to_pylist()
            starts, ends = starts[:-1], ends[:-1]
        if len(starts) and self.header:
            starts, ends, self.header = starts[1:], ends[1:], False
        single = ends - starts == 1
        for a, b in zip(starts[~single].tolist(), ends[~single].tolist()):
            others.append(("\n".join(lines.slice(a, b - a).to_pylist()), None, None, None, False))
        return lines.take(pa.array(starts[single])), others

    def end(self) -> list[tuple]:
        return self.piece(1 if self.whole else 0)


_CUT = "value string, _file string, _split long, _kind int, _header boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["value", "_file", "_split", "_kind", "_header"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    cutter = None
    for batch in batches:
        files, splits, opens = (batch.column(k) for k in (1, 2, 3))
        starts = splits.to_numpy()
        same = pc.equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero(~same | (starts[1:] != starts[:-1])) + 1).tolist(), len(starts)] if len(starts) else []
        for a, b in zip(edges, edges[1:]):
            place = (files[a].as_py(), int(starts[a]))
            if cutter is None or cutter.place != place:
                if cutter is not None and (left := cutter.end()):
                    yield made(left)
                cutter = _Cutter(*place, opens[a].as_py())
            rows, others = cutter.add(batch.column(0).slice(a, b - a))
            if len(rows):
                none = [pa.nulls(len(rows), t) for t in types[1:4]]
                yield pa.RecordBatch.from_arrays([rows, *none, pa.array(np.zeros(len(rows), dtype=bool))], names)
            if others:
                yield made(others)
    if cutter is not None and (left := cutter.end()):
        yield made(left)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(value): every row of the files but their headers, with the line breaks inside it."""
    lines = _lines(spark, path)
    # At most one line for each split of a scan; the join must keep the order of the lines.
    opened = lines.join(F.broadcast(_open_splits(lines)), _SPLIT, "left")
    cut = opened.select("value", *_SPLIT, F.coalesce("_open", F.lit(0)).alias("_open")).mapInArrow(_cut, _CUT)
    cut = durable(cut)
    # Pieces are the edges of splits: two for each at most. A row has all pieces from one of kind 1 to the next.
    begun = Window.partitionBy("_file").orderBy("_split", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut.where("_kind is not null").withColumn("_begin", F.max(F.when(F.col("_kind") == 1, F.col("_split"))).over(begun))
    parts = F.array_sort(F.collect_list(F.struct("_split", "_kind", "value")))
    joined = pieces.groupBy("_file", "_begin").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.max(F.expr("_header and _kind = 1")).alias("_header")
    )
    rows = cut.where("_kind is null").select("value", "_header").unionByName(joined.select("value", "_header"))
    value = F.regexp_replace("value", r"\r$", "")
    return rows.where(~F.col("_header")).select(value.alias("value")).where("value <> ''")


def read_delimited(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Reads with the declared types: no inference pass over the data.

    ``NA`` and an empty field are both missing. Quotes inside a field are doubled, and a field in quotes may hold
    line breaks and leading or trailing spaces; a field with quotes in it must be in quotes. The first row of each
    file is its header, blank lines are no rows. A file of any size is read by many tasks. A row that doesn't fit
    the schema stops the job.
    """
    options = {
        "nullValue": MISSING_TEXT, "mode": "FAILFAST", "multiLine": "true", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    df = _records(spark, path).select(F.inline(F.array(F.from_csv("value", ddl, options))))
    texts = [f.name for f in schema if isinstance(f.dataType, StringType)]
    return across(df, texts, lambda c: F.nullif(c, F.lit("")))


def write_delimited(df: DataFrame, path: str) -> None:
    """Writes a folder of part files; fails if it exists. Texts keep their spaces, quotes and line breaks."""
    (
        df.write.options(header=True, nullValue=MISSING_TEXT, quote='"', escape='"', maxRecordsPerFile=ROWS_IN_FILE)
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def stamped(folder: str, name: str, at: dt.datetime) -> str:
    """``folder/name_yyyymmddHHMMSS`` for a result written at the given time."""
    return f"{folder}/{name}_{at:%Y%m%d%H%M%S}"
