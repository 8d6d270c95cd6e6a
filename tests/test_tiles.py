"""Tiles by rank selection against a window over all rows."""

import decimal
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronage.operators import ranking, tiles

MEASURES = {"up": ("a", False), "down": ("a", True), "other": ("b", True), "cents": ("c", False)}


def rows(kind, n=3000):
    random.seed(n)
    out = []
    for i in range(n):
        hot = random.random() < 0.4
        a = {"hot": 7 if hot else random.randint(-50, 50), "wide": random.choice([1e-300, 1e300, -1e9]) * random.random()}[kind]
        b = None if random.random() < 0.2 else random.choice([0, 0, 1, 5])
        out.append((i * 7919 % n + (1 << 52), float(a), b, decimal.Decimal(random.randint(0, 10**9)).scaleb(-2)))
    return out


def by_window(df, count):
    made = {}
    for name, (measure, descending) in MEASURES.items():
        order = F.desc(measure) if descending else F.asc(measure)
        tile = F.ntile(count).over(Window.partitionBy(F.col(measure).isNull()).orderBy(order, F.asc("id")))
        made[name] = F.when(F.col(measure).isNotNull(), tile)
    return df.withColumns(made)


@pytest.mark.parametrize("kind", ["hot", "wide"])
@pytest.mark.parametrize("count", [1, 4, 7])
def test_tiles_without_a_sort(spark, monkeypatch, kind, count):
    monkeypatch.setattr(tiles, "BINS", 8)
    monkeypatch.setattr(tiles, "FEW", 20)
    df = spark.createDataFrame(rows(kind), "id long, a double, b int, c decimal(12,2)").repartition(5)
    found = ranking.exact_ntiles(df, MEASURES, "id", count)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, by_window(df, count).collect()))


@pytest.mark.parametrize("n", [0, 1, 3, 5])
def test_fewer_rows_than_tiles(spark, n):
    df = spark.createDataFrame(rows("hot")[:n], "id long, a double, b int, c decimal(12,2)")
    found = ranking.exact_ntiles(df, MEASURES, "id", 4)
    assert sorted(map(str, found.collect())) == sorted(map(str, by_window(df, 4).collect()))


def test_values_that_are_no_numbers_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FEW", 5)
    texts = spark.createDataFrame([(i, f"t{i % 40:03}") for i in range(200)], "id long, a string")
    found = ranking.exact_ntile(texts, "a", "id", 4, "tile")
    assert [r["count"] for r in found.groupBy("tile").count().orderBy("tile").collect()] == [50] * 4
    nan = spark.createDataFrame([(i, float("nan") if i < 30 else float(i)) for i in range(100)], "id long, a double")
    found = ranking.exact_ntile(nan, "a", "id", 4, "tile")
    assert found.where("isnan(a)").agg(F.min("tile")).first()[0] == 3
    repeated = spark.createDataFrame([(1, 2.0)] * 100, "id long, a double")
    found = ranking.exact_ntile(repeated, "a", "id", 4, "tile")
    assert [r["count"] for r in found.groupBy("tile").count().collect()] == [25] * 4
    close = spark.createDataFrame([((1 << 60) + i % 50, i) for i in range(100)], "a long, id long")
    found = ranking.exact_ntile(close, "a", "id", 4, "tile")
    assert [r["count"] for r in found.groupBy("tile").count().collect()] == [25] * 4
