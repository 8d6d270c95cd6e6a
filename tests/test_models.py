"""Invariants of segmentation, affinity and regression."""

import dataclasses
import threading

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from patronage.operators import encode
from patronage.plans import affinity, boosting, lloyd, regress, retail, ridge, segments, subspace
from patronage.plans import bookings as booking_plan
from patronage.registry import models
from patronage.sources import views

CELLS = [
    (1, 10, 5.0), (1, 11, 1.0), (2, 10, 2.0), (2, 12, 7.0), (3, 11, 3.0), (3, 13, -4.0),
    (4, 13, 6.0), (5, 10, 1.0), (5, 12, 2.0), (6, 11, 8.0), (6, 13, 0.0),
]


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(CELLS, "customer_id long, store_code long, value double")


def dense():
    out = np.zeros((6, 4))
    for c, s, v in CELLS:
        out[c - 1, s - 10] += v
    return out


def test_singular_values_and_energy(matrix):
    found = affinity.decompose(matrix)
    assert np.allclose(found.values, np.linalg.svd(dense(), compute_uv=False))
    shares = [r.share for r in affinity.energy(found, matrix).orderBy("position").collect()]
    assert shares == sorted(shares) and abs(shares[-1] - 1) < 1e-9
    rank = found.rank_for()
    assert shares[rank - 1] >= 0.9 and (rank == 1 or shares[rank - 2] < 0.9)


def test_explicit_number_of_values(matrix):
    found = affinity.decompose(matrix, k=2)
    assert np.allclose(found.values, np.linalg.svd(dense(), compute_uv=False)[:2])
    with pytest.raises(ValueError):
        found.rank_for(0.9999)


@pytest.mark.parametrize("rank", [1, 2, 4])
def test_scores(matrix, rank):
    found = affinity.decompose(matrix)
    rows = affinity.scores(matrix, found, [12, 13], rank).orderBy("customer_id").collect()
    u, s, v = np.linalg.svd(dense(), full_matrices=False)
    wanted = (u[:, :rank] * s[:rank]) @ v[:rank]
    assert np.allclose([[r["12"], r["13"]] for r in rows], wanted[:, 2:])


def test_predictions_ignore_rounding_noise(matrix):
    found = affinity.decompose(matrix)
    long = affinity.predictions(affinity.scores(matrix, found, [12, 13], 4)).collect()
    assert {(r.customer_id, r.store_code): r.prediction for r in long} == {
        (c, s): int(dense()[c - 1, s - 10] > 0) for c in range(1, 7) for s in (12, 13)
    }


def test_few_values_of_many_stores(spark):
    cells = spark.range(20_000).selectExpr("id % 50 as customer_id", "id as store_code", "1.0D + id % 50 + id % 7 as value")
    found = affinity.decompose_share(cells, 0.5)
    # The customers' rows have no store in common, so the singular values are their lengths.
    lengths = [r[0] ** 0.5 for r in cells.groupBy("customer_id").agg(F.sum(F.col("value") * F.col("value")).alias("s")).select("s").collect()]
    assert np.allclose(found.values, sorted(lengths)[::-1][: len(found.values)])
    rank = found.rank_for(0.5)
    assert rank == 1 + int((np.cumsum(np.sort(np.square(lengths))[::-1]) < 0.5 * np.square(lengths).sum()).sum())


def test_low_rank_scores_of_many_stores(spark):
    rng = np.random.default_rng(3)
    rows = [(c, int(s), float(rng.normal(10, 3))) for c in range(12) for s in rng.choice(20_000, 1500, replace=False)]
    rows += [(77, s, 1.0 + s % 5) for s in range(0, 20_000, 3)]  # one customer holds a third of all cells
    cells = spark.createDataFrame(rows, "customer_id long, store_code long, value double")
    customers = sorted({c for c, _, _ in rows})
    table = np.zeros((len(customers), 20_000))
    for c, s, v in rows:
        table[customers.index(c), s] += v
    u, s, v = np.linalg.svd(table, full_matrices=False)
    found = affinity.decompose(cells, k=4)
    assert np.allclose(found.values, s[:4])
    scored = affinity.scores(cells, found, [3, 19_998], 4).orderBy("customer_id").collect()
    wanted = ((u[:, :4] * s[:4]) @ v[:4])[:, [3, 19_998]]
    assert np.allclose([[r["3"], r["19998"]] for r in scored], wanted, atol=1e-5)


@pytest.mark.parametrize("block", [2, 3])
def test_tiles_of_any_size_give_the_same_values(matrix, monkeypatch, block):
    monkeypatch.setattr(subspace, "BLOCK", block)
    monkeypatch.setattr(subspace, "CELLS_AT_ONCE", 4)
    found = affinity.decompose(matrix)
    assert np.allclose(found.values, np.linalg.svd(dense(), compute_uv=False))
    rows = affinity.scores(matrix, found, [12, 13, 99], 2).orderBy("customer_id").collect()
    u, s, v = np.linalg.svd(dense(), full_matrices=False)
    wanted = (u[:, :2] * s[:2]) @ v[:2]
    assert np.allclose([[r["12"], r["13"], r["99"]] for r in rows], np.column_stack([wanted[:, 2:], np.zeros(6)]))


def test_an_empty_matrix_has_no_values(matrix):
    assert len(affinity.decompose(matrix.where("false")).values) == 0
    assert len(affinity.decompose_share(matrix.where("value = 0")).values) == 0


def test_full_rank_scores_are_those_of_all_values(matrix):
    rows = affinity.full_rank_scores(matrix, [12, 13]).orderBy("customer_id").collect()
    assert np.allclose([[r["12"], r["13"]] for r in rows], dense()[:, 2:])
    assert abs(affinity.squares(matrix).first()[0] - affinity.decompose(matrix).total) < 1e-9


def test_values_are_added_until_the_share_is_reached(matrix):
    found = affinity.decompose_share(matrix, 0.9)
    assert (found.values**2).sum() >= 0.9 * found.total
    assert found.rank_for(0.9) == affinity.decompose(matrix).rank_for(0.9)


@pytest.fixture(scope="module")
def stores(spark, small):
    cleaned = retail.clean_stores(views.stores(spark, small))
    return segments.store_features(cleaned, segments.levels_of(cleaned, "region"))


def test_clusters(stores):
    rows = segments.cluster_labels(stores, k=3, restarts=3).collect()
    assert {r.cluster for r in rows} == {1, 2, 3}
    assert len(rows) == stores.count()
    assert {r.cluster for r in segments.hierarchy_labels(stores, 2).collect()} == {1, 2}


def test_best_of_restarts_and_elbow(stores):
    best = segments.best_kmeans(stores, 3, restarts=3).cost
    mllib = min(KMeans(k=3, seed=i).fit(stores).summary.trainingCost for i in range(3))
    assert best <= mllib + 1e-9
    costs = {r.k: r.cost for r in segments.elbow_curve(stores, ks=[2, 3, 8]).collect()}
    assert costs[8] < costs[3] < costs[2]


def test_runs_of_one_pass_are_those_of_single_fits(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in points], "a double, b double").repartition(3)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    runs = lloyd.fit(rows, [3, 2, 3], [1, 2, 3])
    alone = [lloyd.fit(rows, [k], [s])[0] for k, s in ((3, 1), (2, 2), (3, 3))]
    for run, single in zip(runs, alone):
        assert np.allclose(run.centres, single.centres) and abs(run.cost - single.cost) < 1e-6
        apart = ((points[:, None, :] - run.centres[None]) ** 2).sum(axis=2)
        near = apart.argmin(axis=1)
        assert abs(apart.min(axis=1).sum() - run.cost) < 1e-6
        assert np.allclose(run.centres, [points[near == i].mean(axis=0) for i in range(len(run.centres))])
    same = VectorAssembler(inputCols=["a", "a"], outputCol="features").transform(spark.createDataFrame([(1.0,)] * 50, "a double"))
    assert len(lloyd.fit(same, [4], [1])[0].centres) == 1
    assert lloyd.fit(rows.limit(0), [2], [1])[0].cost == 0.0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, b double")
    ranged = encode.range_scale(df, ["a", "b"]).collect()
    assert np.allclose([r.a_range for r in ranged], [0, 1 / 3, 1])
    assert [r.b_range for r in ranged] == [None] * 3
    scaled = encode.sd_scale(df, ["a"]).collect()
    assert np.allclose([r.a_sd for r in scaled], np.array([1, 2, 4]) / np.std([1, 2, 4], ddof=1))


def test_levels_get_alphabetical_numbers_and_null_the_next(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted((str(r.c), r.c_index) for r in encode.level_index(df, ["c"]).collect()) == [("None", 2), ("a", 0), ("b", 1), ("b", 1)]
    dictionary = encode.level_dictionary(df, ["c"])
    later = spark.createDataFrame([("z",), ("b",), (None,)], "c string")
    assert {r.c: r.c_index for r in encode.level_numbers(later, dictionary, ["c"]).collect()} == {"z": 3, "b": 1, None: 2}
    assert encode.level_index(df.limit(0), ["c"]).collect() == []
    other = encode.one_hot(later, "c", ["a", "b"], "c", other=True).collect()
    assert [(r.c_0, r.c_1, r.c_other) for r in other] == [(0, 0, 1), (0, 1, 0), (None, None, None)]
    hot = encode.one_hot(df, "c", ["a", "b"], "c").collect()
    assert [(r.c_0, r.c_1) for r in hot] == [(0, 1), (1, 0), (None, None), (0, 1)]


@pytest.fixture(scope="module")
def vectors(spark, small):
    return regress.vectors(booking_plan.features(views.bookings(spark, small)))


def test_ridge_save_and_load(spark, vectors, tmp_path):
    train, test = vectors
    model = regress.ridge_cv(train, strengths=(1.0, 100.0), folds=5).bestModel
    path = str(tmp_path / "ridge")
    model.save(spark, path)
    again = ridge.RidgeModel.load(spark, path)
    first, second = (
        [r.p for r in regress.predict(m, test, "p").orderBy(*views.BOOKING_KEY, "p").collect()]
        for m in (model, again)
    )
    assert first == second and len(first) == test.count()


def ridge_rows(spark, n=400):
    """Rows with a category of three levels (one never seen), two numbers, and one number that depends on others."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        level, a, b = int(rng.integers(0, 3)), float(rng.normal(3, 2)), float(rng.normal(-1, 5))
        label = 4 + 2 * a - b + (0, 7, -3)[level] + float(rng.normal())
        rows.append((i % 5, float(level), a, b, 2 * a - b + 1, label))
    df = spark.createDataFrame(rows, "fold int, level double, a double, b double, both double, label double")
    named = with_levels(df.repartition(3), "level", 4)
    tree = VectorAssembler(inputCols=["level", "a", "b"], outputCol="x").transform(named)
    return VectorAssembler(inputCols=["level", "a", "b", "both"], outputCol="dependent").transform(tree)


def with_levels(df, column, levels):
    meta = {"ml_attr": {"type": "nominal", "name": column, "num_vals": levels}}
    return df.withColumn(column, F.col(column).alias(column, metadata=meta))


def test_ridge_path_agrees_with_mllib(spark):
    rows = ridge_rows(spark)
    columns = ridge.columns_of(rows, "x")
    assert (columns.width, columns.starts) == (7, {0: 1})
    sums = ridge.fold_products(rows, columns, "label", "fold", 5)
    every = np.arange(1, columns.width)
    hot = OneHotEncoder(inputCols=["level"], outputCols=["hot"], dropLast=False).fit(rows).transform(rows)
    flat = VectorAssembler(inputCols=["hot", "a", "b"], outputCol="flat").transform(hot).persist()
    for held in (None, 2):
        part = sums.sum(axis=0) if held is None else sums.sum(axis=0) - sums[held]
        kept = flat if held is None else flat.where(F.col("fold") != held)
        for strength, found in zip((0.1, 5.0), ridge.path(part, (0.1, 5.0), every)):
            fitted = LinearRegression(featuresCol="flat", regParam=strength, elasticNetParam=0.0, standardization=False, solver="normal").fit(kept)
            assert np.allclose(found[1:], fitted.coefficients.toArray(), atol=1e-6)
            assert abs(found[0] - fitted.intercept) < 1e-6
            errors = [(r.label - r.prediction) ** 2 for r in fitted.transform(kept).collect()]
            assert abs(ridge.squared_error(part, found) - np.mean(errors)) < 1e-6


def test_ridge_leaves_dependent_columns_out_and_predicts(spark):
    rows = ridge_rows(spark)
    found = ridge.search(rows, "dependent", (1e-6, 1.0, 1e4), 5)
    assert found.strengths[int(np.argmin(found.errors))] == found.bestModel.strength == 1e-6
    coefficients = found.bestModel.coefficients
    assert coefficients[4] == 0  # the level that never occurs
    assert (coefficients[1:4] == 0).sum() == 1 and (coefficients[5:] == 0).sum() == 1
    assert found.errors[0] < 1.2
    judged = found.bestModel.transform(rows)
    assert judged.select(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0] < 1.1
    plan = rows.limit(0)
    assert ridge.search(plan, "x", (1.0,), 5).bestModel.coefficients.tolist() == [0.0] * 7


def test_ridge_reads_the_rows_once(spark, monkeypatch):
    passes = []
    whole = ridge.fold_products
    monkeypatch.setattr(ridge, "fold_products", lambda *a: passes.append(a) or whole(*a))
    ridge.search(ridge_rows(spark), "x", regress.STRENGTHS, 5)
    assert len(passes) == 1


def boosted_predictions(model, rows):
    return [r.prediction for r in model.transform(rows).orderBy("label", "fold").collect()]


def test_boosted_trees_learn_alike_in_one_block_or_many_and_after_a_stop(spark, tmp_path, monkeypatch):
    rows = ridge_rows(spark, 600)
    settings = boosting.BoostedTrees(12, 0.3, 3, rows=0.7, columns=0.7, seed=7, stage=5, features="x", keys=("label",))
    whole = settings.fit(rows)
    predicted = boosted_predictions(whole, rows)
    spread = rows.agg(F.var_pop("label")).first()[0]
    errors = np.mean([(p - r.label) ** 2 for p, r in zip(predicted, rows.orderBy("label", "fold").collect())])
    assert len(whole.trees) == 12 and errors < 0.3 * spread
    folder = str(tmp_path / "trees")
    part = dataclasses.replace(settings, trees=7).fit(rows, folder)
    assert len(part.trees) == 7
    assert np.allclose(boosted_predictions(settings.fit(rows, folder), rows), predicted)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    assert np.allclose(boosted_predictions(settings.fit(rows), rows), predicted)
    assert settings.fit(rows.limit(0)).trees == ()


def test_boosted_tree_against_plain_split(spark):
    rows = ridge_rows(spark, 300)
    model = boosting.BoostedTrees(1, 1.0, 1, least_rows=20, features="x", keys=("label",)).fit(rows)
    found = model.transform(rows).select("level", "a", "b", "label", "prediction").collect()
    label = np.array([r.label for r in found])
    best = np.inf
    sides = [np.array([r.level in group for r in found]) for group in ({0.0}, {1.0}, {2.0})]
    for k, name in ((1, "a"), (2, "b")):
        column = np.array([r[name] for r in found])
        sides += [column <= cut for cut in model.cuts[k]]
    for left in sides:
        if min(left.sum(), (~left).sum()) >= 20:
            best = min(best, label[left].var() * left.sum() + label[~left].var() * (~left).sum())
    predicted = np.array([r.prediction for r in found])
    assert abs(((label - predicted) ** 2).sum() - best) < 1e-6 * best


def test_search_and_blend(vectors):
    train, test = vectors
    few = {n: e for n, e in regress.search_candidates(trees=2).items() if n in ("linear_1", "forest_4")}
    board = regress.leaderboard(train, few)
    errors = [error for _, _, error in board]
    assert errors == sorted(errors) and len(errors) == 2
    winner = regress.search(train, few)
    boosted = regress.fit(regress.boosted_trees(trees=2, depth=2), train)
    linear = regress.ridge_cv(train, strengths=(1.0,), folds=5).bestModel
    out = regress.blended(test, boosted, winner, linear)
    mix = 0.55 * F.col("boosted") + 0.40 * F.col("winner") + 0.05 * F.col("ridge")
    assert out.where(F.abs(mix - F.col("prediction")) > 1e-6).count() == 0
    assert out.count() == test.count()


def test_candidates_are_fitted_side_by_side(vectors, monkeypatch):
    train, _ = vectors
    met, own = threading.Barrier(2, timeout=60), regress.fit
    few = {n: e for n, e in regress.search_candidates(trees=1).items() if n in ("linear_1", "linear_100")}
    alone = {n: regress.leaderboard(train, {n: e})[0][2] for n, e in few.items()}
    monkeypatch.setattr(regress, "fit", lambda estimator, rows: (met.wait(), own(estimator, rows))[1])
    assert {name: error for _, name, error in regress.leaderboard(train, few)} == pytest.approx(alone)


def test_ten_candidates():
    assert len(regress.search_candidates()) == 10


def test_trees_get_a_bin_for_every_level(vectors):
    train, _ = vectors
    model = regress.fit(regress.search_candidates(trees=1)["boosted_3"], train)
    levels = [a.get("num_vals") or len(a["vals"]) for a in train.schema[regress.TREE_INPUT].metadata["ml_attr"]["attrs"]["nominal"]]
    assert model.getMaxBins() >= max(levels)


def test_registered_queries_fit_the_whole_models(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def stop(*args, **kwargs):
        raise Fitted(args, kwargs)

    monkeypatch.setattr(models, "_vectors", lambda spark, folder: (None, None))
    monkeypatch.setattr(models.booking_plan, "features", lambda rows: None)
    monkeypatch.setattr(models.views, "bookings", lambda spark, folder: None)
    monkeypatch.setattr(regress, "fit", stop)
    monkeypatch.setattr(regress, "leaderboard", stop)
    monkeypatch.setattr(regress, "spend_predictions", stop)
    with pytest.raises(Fitted) as caught:
        models.ml_gbt(spark, "")
    trees = caught.value.args[0][0]
    assert (trees.trees, trees.depth, trees.rate, trees.rows, trees.columns) == (400, 8, 0.001, 0.6, 0.6)
    with pytest.raises(Fitted) as caught:
        models.ml_leaderboard(spark, "")
    whole = regress.search_candidates()
    candidates = caught.value.args[0][1]
    assert set(candidates) == set(whole)
    assert candidates["forest_8"].getNumTrees() == whole["forest_8"].getNumTrees()
    with pytest.raises(Fitted) as caught:
        models.ml_blend_predictions(spark, "")
    assert caught.value.args == ((None,), {})
    assert len(regress.STRENGTHS) == 31 and {0.01, 1.0, 100.0} <= {round(s, 6) for s in regress.STRENGTHS}
