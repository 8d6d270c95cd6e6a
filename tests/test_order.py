"""Positions, tiles, running totals and quantiles against the plain definitions, also under heavy skew."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronage.operators import joins, profile, ranking


def skewed(spark, rows=5000):
    """A third of the rows share one value; some have none."""
    random.seed(7)
    data = []
    for key in range(rows):
        draw = random.random()
        value = 50 if draw < 0.34 else None if draw < 0.38 else random.randint(0, 99)
        data.append((key, value))
    random.shuffle(data)
    return spark.createDataFrame(data, "id int, x int").repartition(5)


@pytest.mark.parametrize("tiles", [1, 4, 7])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [None, 5])
def test_tiles_equal_the_builtin(spark, tiles, descending, partitions):
    df = skewed(spark)
    order = F.col("x").desc() if descending else F.col("x").asc()
    builtin = df.where("x is not null").withColumn("t", F.ntile(tiles).over(Window.orderBy(order, "id")))
    wanted = {r.id: r.t for r in builtin.collect()}
    found = {r.id: r.t for r in ranking.exact_ntile(df, "x", "id", tiles, "t", descending, partitions).collect()}
    assert len(found) == 5000
    assert {k: t for k, t in found.items() if t is not None} == wanted
    sizes = np.bincount(list(wanted.values()))[1:]
    assert sizes.max() - sizes.min() <= 1


def test_tiles_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, None)], "id int, x int")
    found = {r.id: r.t for r in ranking.exact_ntile(df, "x", "id", 4, "t").collect()}
    assert found == {1: 2, 2: 1, 3: None}


def test_a_hot_value_is_split_over_partitions(spark):
    df = spark.createDataFrame([(i, 1) for i in range(4000)], "id int, x int")
    order = [F.col("x").asc(), F.col("id").asc()]
    parts = df.repartitionByRange(4, *order).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000
    positions = ranking.global_position(df, order, "position", 4).collect()
    assert all(r.position == r.id + 1 for r in positions)


@pytest.mark.parametrize("partitions", [None, 6])
def test_running_total(spark, partitions):
    df = skewed(spark).where("x is not null")
    order = [F.col("x").desc(), F.col("id").asc()]
    found = {r.id: r.total for r in ranking.running_total(df, order, "x", "total", partitions).collect()}
    total = 0
    for row in sorted(df.collect(), key=lambda r: (-r.x, r.id)):
        total += row.x
        assert found[row.id] == total


@pytest.mark.parametrize("partitions", [None, 6])
def test_quantiles(spark, partitions):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = skewed(spark).withColumn("g", F.when(F.col("id") % 3 != 0, "big").when(F.col("id") % 2 == 0, "odd"))
    rows = df.collect()
    everything = ranking.exact_quantiles(df, "x", probabilities, (), partitions).first()
    wanted = np.quantile([r.x for r in rows if r.x is not None], probabilities)
    assert np.allclose(list(everything), wanted)
    for row in ranking.exact_quantiles(df, "x", probabilities, ["g"], partitions).collect():
        wanted = np.quantile([r.x for r in rows if r.g == row.g and r.x is not None], probabilities)
        assert np.allclose(list(row)[1:], wanted)


def test_histogram_takes_its_greatest_value_into_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)] + [(None,)], "x double")
    counts = {r.bin: r.n for r in profile.histogram(df, "x", 30).collect()}
    assert counts == {**{b: 1 for b in range(29)}, 29: 2}
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [tuple(r) for r in profile.histogram(same, "x").collect()] == [(0, 2)]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), (None, 2)], "g string, v int")
    shares = joins.share_of_group(df, "v", ["g"], "s").groupBy("g").agg(F.sum("s").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares) and len(shares) == 3
