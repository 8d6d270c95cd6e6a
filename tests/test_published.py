"""Results that are published whole, or not taken."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patronage.plans import affinity, regress
from patronage.sources import published

AT = dt.datetime(2020, 1, 2, 3, 4, 5)
SCHEMA = "id long, text string, amount decimal(12,2), score double, day date"


@pytest.fixture
def rows(spark):
    made = [(i, [None, "a,b", 'say "x"', "two\nlines", " é "][i % 5], None, i / 7, dt.date(2020, 1, 1 + i % 28)) for i in range(100)]
    return spark.createDataFrame(made, SCHEMA).withColumn("amount", F.expr("CAST(id / 3 AS decimal(12,2))")).repartition(4)


def test_a_result_is_read_as_it_was_written(spark, rows, tmp_path):
    path = published.publish(rows, str(tmp_path), "out", AT)
    assert path.endswith("out_20200102030405")
    assert sorted(map(str, published.read_published(spark, path).collect())) == sorted(map(str, rows.collect()))
    empty = published.publish(rows.limit(0), str(tmp_path), "none", AT)
    assert published.read_published(spark, empty).count() == 0
    with pytest.raises(PySparkException):
        published.publish(rows, str(tmp_path), "out", AT)


def test_a_broken_write_is_no_result(spark, rows, tmp_path):
    first = published.publish(rows, str(tmp_path), "out", AT)
    broken = rows.withColumn("score", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(PySparkException):
        published.publish(broken, str(tmp_path), "out", AT + dt.timedelta(days=1))
    later = str(tmp_path / "out_20200103030405")
    with pytest.raises(published.NotPublished):
        published.read_published(spark, later)
    assert published.latest(spark, str(tmp_path), "out") == first
    assert published.latest(spark, str(tmp_path), "other") is None
    assert published.latest(spark, str(tmp_path / "nowhere"), "out") is None


def test_a_part_that_is_lost_or_changed_is_noticed(spark, rows, tmp_path):
    path = published.publish(rows, str(tmp_path), "out", AT)
    parts = sorted(Path(path, "rows").glob("part-*"))
    os.rename(parts[0], tmp_path / "aside")
    with pytest.raises(published.NotPublished):
        published.read_published(spark, path)
    os.rename(tmp_path / "aside", parts[0])
    text = parts[1].read_text()
    for hidden in Path(path, "rows").glob(".*.crc"):
        hidden.unlink()
    parts[1].write_text(text.replace("2020-01-", "2020-02-", 1))
    with pytest.raises(published.NotPublished):
        published.read_published(spark, path)


def test_jobs_end_in_a_published_result(spark, tmp_path, monkeypatch):
    bought = spark.createDataFrame([(1, 10, 5.0), (2, 11, 3.0), (1, 11, 0.0)], "customer_id long, store_code long, revenue double")
    asked = spark.createDataFrame([(1, "10"), (2, "10")], "customer_id long, store_code string")
    path = affinity.run(bought, asked, [10], str(tmp_path), AT, rank=1)
    assert [r.prediction for r in published.read_published(spark, path).orderBy("customer_id").collect()] == [1, 0]
    monkeypatch.setattr(regress, "spend_predictions", lambda features, **settings: features)
    path = regress.run(bought, str(tmp_path), AT)
    assert path.endswith("spend_20200102030405") and published.read_published(spark, path).count() == 3
