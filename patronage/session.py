"""Session settings and durable intermediate results."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once, about, or one row
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("patronage")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for durable intermediates, as the cluster names it in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local folder
    would be lost with the machine.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active is not None:
        return active
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="patronage-checkpoints-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table on shared storage.

    A lost executor then costs no recomputation of what lies before, and each later reader takes only the
    columns it needs, with sizes Catalyst knows. The tables of one application share its checkpoint folder.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes durable tables that nothing reads any more."""
    for table in tables:
        files, spark = table.inputFiles(), table.sparkSession
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if folder.getName().startswith("table-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles that nothing refers to.

    It does so when the driver collects what refers to them as garbage, which may not happen for long, as few rows
    reach the driver.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile sends whole texts to Python workers in batches of bounded bytes; 10,000 texts at once
    are held by the executor and the worker several times. A setting of the caller's own stays."""
    own = spark.conf.get(_BATCH_SETTING, None)
    if own is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH_SETTING)
