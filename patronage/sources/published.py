"""Results published whole: rows first, a manifest last, and readers take only what the manifest vouches for.

The rows are counted and summed up to a checksum while they are written. The manifest, with both figures and the
schema, is written after the rows are committed; a folder without it is not a result. Reading counts and sums the
files again, so a part that was lost or changed afterwards is noticed.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronage.sources.delimited import read_delimited, stamped, write_delimited

_LOW_BITS = (1 << 32) - 1


class NotPublished(Exception):
    """The folder is no whole result."""


def _figures(df: DataFrame) -> list[Column]:
    """Number of rows, and a sum of row hashes that no order changes; missing and empty texts are the same."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    hashed = F.xxhash64(*texts).bitwiseAND(F.lit(_LOW_BITS))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("long").alias("checksum")]


def publish(df: DataFrame, folder: str, name: str, at: dt.datetime) -> str:
    """Writes ``df`` as delimited text below a stamped folder, which it returns; fails if there is one already."""
    spark, path = df.sparkSession, stamped(folder, name, at)
    seen = Observation(f"{name}-{at:%H%M%S%f}")
    write_delimited(df.observe(seen, *_figures(df)), f"{path}/rows")
    manifest = {"rows": seen.get["rows"], "checksum": seen.get["checksum"], "schema": df.schema.json()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published result; ``NotPublished`` if its manifest is missing or its rows differ from it."""
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise NotPublished(f"{path} has no complete manifest")
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    rows = read_delimited(spark, f"{path}/rows", StructType.fromJson(json.loads(manifest["schema"])))
    found = rows.agg(*_figures(rows)).first().asDict()
    wanted = {k: manifest[k] for k in found}
    if found != wanted:
        raise NotPublished(f"{path} has {found}, its manifest says {wanted}")
    return rows


def latest(spark: SparkSession, folder: str, name: str) -> str | None:
    """The newest whole result of that name; folders without a manifest are passed over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    found = sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())
    whole = [f for f in found if f.rpartition("_")[0] == name and _exists(spark, f"{folder}/{f}/manifest/_SUCCESS")]
    return f"{folder}/{whole[-1]}" if whole else None
