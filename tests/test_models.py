"""Model preparation, scores and persistence."""

import numpy as np
import pytest
from conftest import SF
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tasador.operators import models
from tasador.plans.lineage import cut_lineage
from tasador.queries import views
from tasador.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def listings(spark):
    df = views.listings(spark, SF)
    # a price the features explain, so that a model can be told from a mean
    price = F.coalesce("m2_construidos", F.lit(50.0)) * 1500 + F.col("Exterior") * 20000 + 30000
    return cut_lineage(df.withColumn("Precio", price))


def test_trimming_example(spark):
    rows = [("m", 0, i, 0.0, float(r)) for i, r in enumerate([1, 1, 1, 10])]
    oof = spark.createDataFrame(rows, "model string, fold int, id long, y double, y_hat double")
    kept = models.trim_residuals(oof).collect()
    assert sorted(r["r"] for r in kept) == [1, 1, 1]
    assert models.trimmed_metrics(oof).first()["mse"] == 1


def test_best_depth_takes_the_smaller_of_equals(spark):
    rows = [(5, 2.0), (5, 4.0), (3, 3.0), (4, 9.0)]
    assert models.best_depth(spark.createDataFrame(rows, "depth int, mse double")).first()["depth"] == 3


def test_unseen_levels_are_all_zeros(spark):
    train = spark.createDataFrame([(1, 1.0, "a", 1), (2, 2.0, "b", 2)], "id long, Precio double, place string, n int")
    other = spark.createDataFrame([(3, 1.0, "zz", None)], train.schema)
    fitted = Pipeline(stages=models.feature_stages(train)).fit(train)
    vector = fitted.transform(other).select(vector_to_array("features")).first()[0]
    assert vector == [1.5, 0.0, 0.0]


def test_splits_do_not_depend_on_partitioning(spark, listings):
    def parts(df):
        return {r["id"]: r["fold"] for r in models.with_fold(models.split_train_test(df)[0]).collect()}

    first = parts(listings)
    assert first == parts(listings.repartition(7))
    assert 0.7 < len(first) / listings.count() < 0.9 and set(first.values()) == set(range(5))


def test_preparation_variants(listings):
    forest, kernel = models.prepare_training(listings), models.prepare_training(listings, "kernel")
    assert kernel.count() == listings.count() > forest.count()
    assert forest.where("m2_utiles is null or planta_numero is null or estado_vivienda is null").isEmpty()


@pytest.mark.parametrize(
    "preset, params",
    [
        ("forest", {"numTrees": 10, "maxDepth": 5}),
        ("bagging", {"members": 6, "maxDepth": 5, "bootstrap": False, "rows": 0.7, "features": 0.7}),
        ("forest", {"numTrees": 6, "maxDepth": 8, "minSplit": 10}),
        ("boosting", {"maxIter": 10, "maxDepth": 3}),
        ("kernel", {"gamma": 0.01, "penalty": 100.0, "components": 200}),
    ],
)
def test_models_beat_the_mean(spark, listings, tmp_path, preset, params):
    train, test = models.split_train_test(models.prepare_training(listings, preset))
    fitted = models.fit(train, preset, params)
    metrics = models.trimmed_metrics(models._predictions(fitted.model, test, preset, 0)).first()
    assert metrics["r2"] > 0.3
    save_model(fitted.model, str(tmp_path / preset))
    again = load_model(str(tmp_path / preset))
    first, second = (m.transform(test).orderBy("id").select("prediction").collect() for m in (fitted.model, again))
    assert first == second


@pytest.mark.parametrize(
    "preset, grid",
    [
        ("boosting", {"maxIter": [1, 8], "maxDepth": [3], "stepSize": [0.3]}),
        ("kernel", {"gamma": [0.01], "penalty": [1.0, 100.0], "components": [50]}),
    ],
)
def test_training_and_scoring(spark, listings, preset, grid):
    fitted, metrics = models.train_model(listings, preset, grid, draws=2)
    assert metrics.first()["r2"] > 0
    if preset == "boosting":
        assert fitted.params["maxIter"] == 8
    weights = models.weights_from(metrics)
    assert weights == {preset: 1.0}
    scored = models.score_listings(listings, {preset: fitted}, weights)
    assert set(listings.columns) < set(scored.columns) and scored.count() == listings.count()
    bad = scored.where(
        (F.col("Diferencia_Ponderada").isNull() != F.col(f"pred_{preset}").isNull())
        | (F.abs(F.col("estimate") - F.col("Precio") - F.col("Diferencia_Ponderada")) > 1e-6)
    )
    assert bad.isEmpty()
    unscored = scored.where("estimate is null").count()
    left_out = "(m2_construidos is null and m2_utiles is null) or habitaciones is null or banos is null"
    # the kernel's training keeps every row, and so does its scoring
    assert unscored == (0 if preset == "kernel" else listings.where(left_out).count())


def test_depth_search(listings):
    train, _ = models.split_train_test(models.prepare_training(listings))
    assert models.depth_search(train, depths=[1, 4], folds=2, trees=3)[0] == 4


def test_draws_are_seeded_and_distinct():
    draws = models.draw_params(models.GRIDS["boosting"], 10)
    assert draws == models.draw_params(models.GRIDS["boosting"], 10)
    assert len({str(d) for d in draws}) == 10


@pytest.mark.parametrize("preset, params", [("forest", {"numTrees": 5, "maxDepth": 4}), ("kernel", {"components": 32})])
def test_scoring_prepares_as_training_did(spark, listings, preset, params):
    prepared = models.prepare_training(listings, preset)
    fitted = models.fit(models.split_train_test(prepared)[0], preset, params)
    own = {r["id"]: r["prediction"] for r in fitted.model.transform(prepared).select("id", "prediction").collect()}
    scored = models.score_listings(listings, {preset: fitted}, {preset: 1.0})
    told = {r["id"]: r["estimate"] for r in scored.select("id", "estimate").collect() if r["estimate"] is not None}
    assert told.keys() == own.keys() and all(abs(told[i] - own[i]) < 1e-6 for i in own)
    if preset == "kernel":
        assert not scored.where("m2_construidos is null and m2_utiles is null and estimate is not null").isEmpty()


def test_estimate_weighs_the_models_that_have_a_value(spark, listings):
    fitted = {}
    for preset, params in (("forest", {"numTrees": 3, "maxDepth": 3}), ("kernel", {"components": 16})):
        fitted[preset] = models.fit(models.prepare_training(listings, preset), preset, params)
    rows = models.score_listings(listings, fitted, {"forest": 0.25, "kernel": 0.75}).collect()
    assert any(r["pred_forest"] is None for r in rows)
    for r in rows:
        alone = r["pred_forest"] is None
        want = r["pred_kernel"] if alone else 0.25 * r["pred_forest"] + 0.75 * r["pred_kernel"]
        assert abs(r["estimate"] - want) < 1e-6


def test_weights_of_a_model_without_error(spark):
    metrics = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", None)], "model string, mse double")
    assert models.weights_from(metrics) == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_models_of_one_preparation_share_the_encoder(spark, listings):
    grids = {"forest": {"numTrees": [4], "maxDepth": [4], "minSplit": [10]}, "boosting": {"maxIter": [3], "maxDepth": [3]}}
    fitted, metrics = models.train_models(listings, ["forest", "boosting"], grids, {"forest": {"maxDepth": 4}}, draws=1)
    assert fitted["forest"].encoder is fitted["boosting"].encoder
    assert {r["model"] for r in metrics.collect()} == {"forest", "boosting"}
    scored = models.score_listings(listings, fitted, {"forest": 0.5, "boosting": 0.5})
    for name, one in fitted.items():
        alone = models.score_listings(listings, {name: one}, {name: 1.0}).select("id", F.col("estimate").alias("alone"))
        both = scored.select("id", f"pred_{name}").join(alone, "id")
        assert both.where(~F.col(f"pred_{name}").eqNullSafe(F.col("alone"))).isEmpty()


def test_kernel_features_fold_in_mean_and_scale(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from tasador.functions.kernels import KernelFeatures

    x = np.array([[1.0, 0.0, 0.0, 5.0], [0.0, 2.0, 0.0, 5.0], [3.0, 0.0, 0.0, 5.0], [0.0, 0.0, 0.0, 5.0]])
    vectors = [(0, Vectors.dense(x[0])), *[(i, Vectors.sparse(4, {j: v for j, v in enumerate(x[i]) if v})) for i in (1, 2)], (3, Vectors.sparse(4, {3: 5.0}))]
    df = spark.createDataFrame(vectors, ["i", "features"])
    model = KernelFeatures(gamma=0.5, components=6, seed=3).fit(df)
    got = np.stack([r["kernel"].toArray() for r in model.transform(df).orderBy("i").collect()])
    deviation = x.std(axis=0, ddof=1)
    z = np.divide(x - x.mean(axis=0), deviation, out=np.zeros_like(x), where=deviation > 0)
    rng = np.random.default_rng(3)
    weights, shift = rng.normal(0.0, 1.0, (4, 6)), rng.uniform(0.0, 2 * np.pi, 6)
    assert np.allclose(got, np.sqrt(2 / 6) * np.cos(z @ weights + shift))


def test_kernel_features_of_mixed_vectors(spark):
    """Dense, sparse and empty vectors in one batch of several chunks, by the formula; each row's width is the components'."""
    from pyspark.ml.linalg import Vectors

    from tasador.functions import kernels

    given = [Vectors.dense(i % 7, 1.0, -i) if i % 3 == 0 else Vectors.sparse(3, [1], [float(i)]) if i % 3 == 1 else Vectors.sparse(3, [], []) for i in range(2500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], ["id", "features"]).coalesce(1)
    own = kernels.RandomFourierFeatures(gamma=0.3, components=5, seed=3, mean=[1.0, 2.0, 3.0], scale=[0.5, 0.1, 0.01])
    told = [r["kernel"].toArray() for r in own.transform(df).orderBy("id").collect()]
    rng = np.random.default_rng(3)
    weights = rng.normal(0.0, np.sqrt(0.6), (3, 5)) * np.array([0.5, 0.1, 0.01])[:, None]
    shift = rng.uniform(0.0, 2 * np.pi, 5) - np.array([1.0, 2.0, 3.0]) @ weights
    want = np.sqrt(2 / 5) * np.cos(np.stack([v.toArray() for v in given]) @ weights + shift)
    assert np.allclose(told, want, atol=1e-12)


def test_training_parts_are_bounded(spark):
    """More partitions for more rows, and the same rows; few rows stay where they are."""
    rows = spark.range(1000, numPartitions=2)
    spread = models.in_parts(rows, part_rows=100)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert spread.rdd.getNumPartitions() == 10 and max(sizes) <= 200
    assert sorted(r["id"] for r in spread.collect()) == list(range(1000))
    assert models.in_parts(rows, part_rows=1000).rdd.getNumPartitions() == 2
