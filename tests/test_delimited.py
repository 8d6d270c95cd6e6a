"""Delimited files that are cut into many splits."""

import random

import pytest

from patronage.sources import delimited

SCHEMA = "id long, text string, amount double"


def made(n):
    rng = random.Random(4)
    parts = ["a", '"', "\n", ",", '""', " ", "\n\n", "é", "NA,", '\n"', "x" * 40]
    return [(i, "t" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) + "e", i / 4) for i in range(n)]


@pytest.mark.parametrize("split_bytes", [500, 1 << 27])
def test_rows_do_not_depend_on_the_splits(spark, tmp_path, split_bytes):
    rows = made(80) + [(80, "long " + 'line "\n' * 200, None), (81, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    delimited.write_delimited(df, str(tmp_path / "csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        back = delimited.read_delimited(spark, str(tmp_path / "csv"), df.schema)
        assert back.schema == df.schema
        assert sorted(map(tuple, back.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "one.csv").write_text("id,text,amount\r\n" + "".join(f'{i},"two\nlines",1\r\n\n' for i in range(100)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert delimited._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        back = delimited.read_delimited(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
        assert sorted(map(tuple, back.collect())) == [(i, "two\nlines", 1.0) for i in range(100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_header_alone_gives_no_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("id,text,amount\n")
    assert delimited.read_delimited(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema).count() == 0
