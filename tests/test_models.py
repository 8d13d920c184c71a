"""Training and scoring with Spark ML."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.operators import evaluation as ev
from txrisk.operators import models, prep, scoring
from txrisk.operators.scoring_set import ScoringSet
from txrisk.plans import pipeline


@pytest.fixture(scope="module")
def matrix(spark):
    """1000 x 20 standard normals, 10 % positives shifted by 2 on five features."""
    rng = np.random.default_rng(42)
    X = rng.normal(size=(1000, 20))
    y = (np.arange(1000) % 10 == 0).astype(int)
    X[y == 1, :5] += 2.0 + rng.normal(scale=0.5, size=(100, 5))
    rows = [(i, X[i].tolist(), int(y[i])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int").cache()
    return df.filter("id % 10 < 7 or id % 30 < 10"), df


def auc(df, model):
    return ev.roc_auc(scoring.score_probability(models.as_vectors(df), model), "fraud_probability", "label").first()[0]


@pytest.mark.parametrize("kind", ["mlp", "logistic", "gbt"])
def test_classifiers_separate(matrix, kind):
    train, df = matrix
    model = models.train_classifier(train, kind, (8,), max_iter=10)
    assert auc(df, model) > 0.9
    p = scoring.score_probability(models.as_vectors(df), model)
    assert p.filter(~F.col("fraud_probability").between(0, 1)).count() == 0


def test_weighted_and_focal(matrix):
    train, df = matrix
    assert auc(df, models.train_weighted(train)) > 0.9
    assert auc(df, models.train_focal(train, max_iter=10)) > 0.9


def reweighted_focal(df, gamma=2.0, alpha=0.25, rounds=4):
    """The usual stand-in: log-loss fits, each weighted by the focal factor of the one before."""
    data = models.as_vectors(df)
    estimator = LogisticRegression(maxIter=50, regParam=0.01)
    model = estimator.fit(data)
    estimator.setWeightCol("w")
    for _ in range(rounds):
        p = vector_to_array("probability")[1]
        hit = F.when(F.col("label") == 1, p).otherwise(1 - p)
        weight = F.when(F.col("label") == 1, alpha).otherwise(1 - alpha) * F.pow(1 - hit, F.lit(gamma))
        model = estimator.fit(model.transform(data).withColumn("w", F.greatest(weight, F.lit(1e-6))).select("features", "label", "w"))
    return model


def test_focal_fit_is_no_worse_than_reweighting(matrix):
    train, _ = matrix

    def loss(model):
        scored = scoring.score_probability(models.as_vectors(train), model)
        return scored.agg(F.avg(ev.loss_focal(F.col("label"), F.col("fraud_probability")))).first()[0]

    assert loss(models.train_focal(train, l2=0.0, max_iter=25)) <= loss(reweighted_focal(train)) + 1e-9


@pytest.mark.parametrize("name", list(ev.LOSSES))
def test_losses_fall_at_every_step(matrix, name):
    train, df = matrix
    model = models.train_loss(train, name, max_iter=6)
    assert len(model.history) > 2 and all(b < a for a, b in zip(model.history, model.history[1:]))
    assert auc(df, model) > 0.9


def test_log_loss_fit_equals_the_library_s(matrix):
    train, _ = matrix
    own = models.train_loss(train, "binary_crossentropy", l2=0.05, max_iter=40)
    library = LogisticRegression(regParam=0.05, maxIter=200, tol=1e-10).fit(models.as_vectors(train))
    assert own.coefficients.toArray() == pytest.approx(library.coefficients.toArray(), abs=1e-4)
    assert own.intercept == pytest.approx(library.intercept, abs=1e-4)


def test_rows_without_a_label_are_left_out(matrix):
    train, _ = matrix
    gap = train.withColumn("label", F.when(F.col("id") % 7 != 0, F.col("label")))
    assert models.with_class_weights(gap).filter("label is null").count() == 0
    assert models.train_loss(gap, "focal", max_iter=2).history[0] > 0


def test_perceptron_refuses_what_it_cannot_do(matrix):
    with pytest.raises(ValueError):
        models.train_classifier(matrix[0], "mlp", weight="w")
    with pytest.raises(ValueError):
        models.train_classifier(matrix[0], "forest of dreams")


def test_tuning_picks_from_the_grid(matrix):
    done = models.tune_classifier(matrix[0], {"hidden": [[4], [8, 4]], "stepSize": [0.001, 0.3]}, max_iter=30)
    points = {r["point"]: r["auc"] for r in done.points.collect()}
    assert len(points) == 4 and len(set(points.values())) > 2 and auc(matrix[1], done.model) > 0.8
    again = models.tune_classifier(matrix[0].repartition(7), {"hidden": [[4]], "stepSize": [0.3]}, max_iter=3)
    assert done.scores.filter("point = 0").count() == again.scores.count()


def test_reconstructor_shape_and_direction(matrix):
    train, df = matrix
    rebuilt = models.train_reconstructor(df, encoding_dim=4).transform(df)
    row = rebuilt.first()
    assert len(row["scaled"]) == len(row["rebuilt"]) == 20
    errors = scoring.anomaly_score(rebuilt, "scaled", "rebuilt").groupBy("label").agg(F.avg("anomaly_score").alias("e"))
    by_label = {r["label"]: r["e"] for r in errors.collect()}
    assert by_label[1] > by_label[0]


def test_full_rank_reconstruction_is_exact(matrix):
    _, df = matrix
    rebuilt = scoring.anomaly_score(models.train_reconstructor(df, 20).transform(df), "scaled", "rebuilt")
    assert rebuilt.agg(F.max("anomaly_score")).first()[0] < 1e-12


def test_error_by_expressions_equals_the_arrays(matrix):
    _, df = matrix
    fitted = models.train_reconstructor(df, 4)
    plain = scoring.anomaly_score(fitted.transform(df), "scaled", "rebuilt", "e").select("id", "e")
    both = fitted.with_error(df).join(plain, "id").agg(F.max(F.abs(F.col("e") - F.col("anomaly_score")))).first()[0]
    assert both < 1e-9


def test_flags_and_ensemble(spark):
    df = spark.createDataFrame([(1, 0.5, 0.05), (2, 0.4, 0.2), (3, None, 0.0)], "transaction_id long, fraud_probability double, anomaly_score double")
    out = scoring.ensemble_or(scoring.apply_threshold(df))
    assert [r["is_fraud_ensemble"] for r in out.orderBy("transaction_id").collect()] == [True, True, False]
    alone = scoring.ensemble_or(scoring.apply_threshold(df.drop("anomaly_score")))
    assert [r["is_fraud_ensemble"] for r in alone.orderBy("transaction_id").collect()] == [True, False, False]
    assert "is_fraud_ensemble" in scoring.score_by_model_type(out, "both").columns
    assert scoring.score_by_model_type(out, "classification").columns == ["transaction_id", "fraud_probability", "is_fraud_classification"]
    with pytest.raises(ValueError):
        scoring.score_by_model_type(out, "oracle")


def test_output_layout_fills_gaps(spark):
    df = spark.createDataFrame([(None, 0.9, 5.0)], "transaction_id string, fraud_probability double, amount double")
    out = scoring.score_output(scoring.ensemble_or(scoring.apply_threshold(df)), epoch=7)
    row = out.first()
    assert row["transaction_id"].startswith("tx_") and row["transaction_id"].endswith("_7") and row["timestamp"] is not None
    assert out.columns[-1] == "amount"


def test_training_job(spark, matrix):
    _, df = matrix
    table = df.select(F.col("id").alias("transaction_id"), F.col("label").alias("fraud_label"), *[F.col("features")[i].alias(f"f{i}") for i in range(20)])
    table = table.withColumn("f3", F.when(F.col("transaction_id") % 50 != 0, F.col("f3")))
    done = pipeline.training_job(table)
    got = {r["metric"]: r["value"] for r in done.metrics.collect()}
    assert got["recall"] > 0.7 and done.features == [f"f{i}" for i in range(20)]


@pytest.mark.parametrize("technique", ["smote", "undersample", "oversample", "adasyn"])
def test_training_job_resamples_and_fits_both_halves(spark, matrix, technique, tmp_path):
    _, df = matrix
    table = df.select(F.col("id").alias("transaction_id"), F.col("label").alias("fraud_label"), *[F.col("features")[i].alias(f"f{i}") for i in range(6)])
    done = pipeline.training_job(table, technique=technique, loss="focal", anomaly_axes=2)
    assert {r["metric"]: r["value"] for r in done.metrics.collect()}["recall"] > 0.5
    assert 0 < done.scoring.anomaly_cut and done.anomaly_metrics.count() == 4


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_saved_set_scores_alike(spark, matrix, kind, tmp_path):
    _, df = matrix
    table = df.select(F.col("id").alias("transaction_id"), F.col("label").alias("fraud_label"), *[F.col("features")[i].alias(f"f{i}") for i in range(6)])
    kept = pipeline.training_job(table, kind=kind, anomaly_axes=2).scoring
    kept.save(spark, str(tmp_path / "set"))
    read = ScoringSet.load(spark, str(tmp_path / "set"))
    assert read.features == kept.features and read.probability_cut == kept.probability_cut and read.anomaly_cut == kept.anomaly_cut
    odd = table.limit(20).unionByName(spark.createDataFrame([(-1, None, None, float("nan"))], "transaction_id long, fraud_label int, f0 double, f1 double"), allowMissingColumns=True).drop("f5")
    rows = [[tuple(r) for r in s.score(odd).orderBy("transaction_id").select("fraud_probability", "anomaly_score").collect()] for s in (kept, read)]
    assert rows[0] == rows[1] and all(0 <= p <= 1 and e >= 0 for p, e in rows[0])


def test_preprocessor_survives_saving_and_unseen_values(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (float("nan"), None)], "x double, c string")
    model = prep.preprocess_pipeline(["x"], ["c"]).fit(train)
    model.write().save(str(tmp_path / "m"))
    model = prep.PreprocessorModel.load(str(tmp_path / "m"))
    # Another mode in the serving table changes nothing.
    serve = spark.createDataFrame([(None, None), (2.0, "z"), (4.0, "a"), (4.0, "a")], "x double, c string")
    got = [list(r["features"]) for r in model.transform(serve).collect()]
    assert model.names() == ["x", "c=a", "c=b"]
    spread = 0.5**0.5
    assert got == [pytest.approx(v) for v in ([0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [2 / spread, 1.0, 0.0], [2 / spread, 1.0, 0.0])]
