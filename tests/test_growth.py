"""Steps whose memory, passes or shuffles must not outgrow the input."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from patronage.plans import affinity, bookings, boosting, lloyd, regress, subspace
from patronage.sources import views


def _cells(spark, customers=40, stores=12):
    rng = np.random.default_rng(5)
    table = np.where(rng.random((customers, stores)) < 0.4, rng.normal(3, 2, (customers, stores)), 0.0)
    rows = [(int(c), int(s), float(table[c, s])) for c, s in zip(*np.nonzero(table))]
    return table, spark.createDataFrame(rows, "customer_id long, store_code long, value double")


@pytest.mark.parametrize("pairs", [0, 1 << 20])
def test_all_values_need_no_vector_per_customer(spark, monkeypatch, pairs):
    monkeypatch.setattr(subspace, "BLOCK", 16)
    monkeypatch.setattr(subspace, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(subspace, "_multiplied", lambda *_, **__: pytest.fail("customer vectors"))
    table, cells = _cells(spark)
    assert np.allclose(affinity.decompose(cells).values, np.linalg.svd(table, compute_uv=False))


def test_a_flat_spectrum_is_not_doubled_up_to(spark, monkeypatch):
    tried = []
    iterated = subspace._iterated
    monkeypatch.setattr(subspace, "_iterated", lambda t, width, *a: tried.append(width) or iterated(t, width, *a))
    monkeypatch.setattr(subspace, "_products", lambda tiles, own=subspace._products: tried.append("products") or own(tiles))
    cells = spark.range(300).selectExpr("id % 300 as customer_id", "id as store_code", "5.0D + id % 7 as value")
    found = affinity.decompose_share(cells, 0.9)
    lengths = np.sort(5.0 + np.arange(300) % 7)[::-1]
    assert np.allclose(found.values, lengths) and tried == [48, "products"]
    rank = found.rank_for(0.9)
    scored = {r.customer_id: r["6"] for r in affinity.scores(cells, found, [6], rank).collect()}
    assert abs(scored[6] - 11.0) < 1e-9 and abs(scored[5]) < 1e-9


def test_a_share_of_many_stores_takes_one_decomposition_and_no_trial(spark, monkeypatch):
    called = []
    for name in ("eigh", "eigvalsh"):
        own = getattr(np.linalg, name)
        monkeypatch.setattr(np.linalg, name, lambda *a, n=name, f=own, **k: called.append(n) or f(*a, **k))
    monkeypatch.setattr(subspace, "FEW_STORES", 10)
    monkeypatch.setattr(subspace, "_iterated", lambda *_: pytest.fail("a trial"))
    table, cells = _cells(spark)
    wide = cells.unionAll(cells.selectExpr("customer_id + 1000", "store_code + 1000", "2 * value"))
    wide = wide.unionAll(spark.range(200).selectExpr("id + 5000", "id + 5000", "1.0D"))
    found = affinity.decompose_share(wide, 0.9)
    svd = np.linalg.svd(table, compute_uv=False)
    assert np.allclose(found.values, np.sort(np.concatenate([svd, 2 * svd, np.ones(200)]))[::-1][: len(found.values)])
    rank = found.rank_for(0.9)
    scored = affinity.scores(wide, found, [5007], len(found.values)).where("customer_id = 5007").first()
    assert abs(scored["5007"] - 1.0) < 1e-6 and rank < len(found.values) and called == ["eigh"]


def test_rows_meet_many_centres_few_at_a_time(monkeypatch):
    sizes = []
    distances = lloyd._distances
    monkeypatch.setattr(lloyd, "_distances", lambda a, b: sizes.append(len(a) * len(b)) or distances(a, b))
    rng = np.random.default_rng(1)
    rows, centres = rng.normal(size=(10_000, 4)), rng.normal(size=(2_000, 4))
    assert (lloyd.nearest_of(rows, centres) == distances(rows, centres).argmin(axis=1)).all()
    assert max(sizes) <= lloyd.DISTANCES_AT_ONCE and len(sizes) > 10


def test_member_statistics_meet_narrow_rows(spark, small, monkeypatch):
    met = []
    attach = bookings.attach_member_stats
    monkeypatch.setattr(bookings, "attach_member_stats", lambda df, source=None: met.append(df) or attach(df, source))
    rows = views.bookings(spark, small)
    found = bookings.features(rows, id_width=9)
    assert met[0].columns == rows.columns and "Join" not in met[0]._jdf.queryExecution().optimizedPlan().toString()
    cleaned = bookings.clean(rows, 9)
    assert found.columns[: len(cleaned.columns)] == cleaned.columns
    assert found.select(cleaned.columns).exceptAll(cleaned).isEmpty() and found.count() == rows.count()


def test_a_tree_takes_one_job_per_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    x = F.array(*[(F.xxhash64("id", F.lit(k)) % 100).cast("double") for k in range(3)])
    rows = spark.range(300).select("id", array_to_vector(x).alias("tree_features"), (x[0] + x[1]).alias("label"))
    jobs = {}
    for trees in (1, 4):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "boosting")
        model = boosting.BoostedTrees(trees, 0.1, 3, keys=("id",)).fit(rows)
        jobs[trees] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{trees}"))
        assert len(model.trees) == trees
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] - jobs[1] == 3 * 3


def test_rows_of_the_leaderboard_take_no_memory_from_the_fits(spark, monkeypatch):
    levels = []
    fit = regress.fit
    monkeypatch.setattr(regress, "fit", lambda estimator, rows: levels.append(rows.storageLevel) or fit(estimator, rows))
    x = F.array(*[(F.xxhash64("id", F.lit(k)) % 100).cast("double") for k in range(2)])
    rows = spark.range(200).select(
        F.lit(0).alias("reservation_id"), (F.col("id") * 5).cast("int").alias("slot"), array_to_vector(x).alias(regress.LINEAR_INPUT), x[0].alias("label")
    )
    board = regress.leaderboard(rows, {"linear": regress._linear(0.01, 0.0)})
    assert [name for _, name, _ in board] == ["linear"]
    assert [(level.useMemory, level.useDisk) for level in levels] == [(False, True)]
