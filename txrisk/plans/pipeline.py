"""The batch jobs: raw transactions to features, features to a scored and evaluated model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions import scalar
from txrisk.operators import clean, evaluation, models, ordering, prep, sampling, scoring
from txrisk.operators.scoring_set import Linear, ScoringSet, linear_part, preparation
from txrisk.operators.sequence import account_history
from txrisk.session import ensure_checkpoint_dir
from txrisk.sources.files import scan_table, sink_parquet


def scalar_features(df: DataFrame) -> DataFrame:
    """Row-wise features for whatever input columns are there, in one projection."""
    have, out = set(df.columns), {}
    if "amount" in have:
        out["amount_log"] = scalar.amount_log(F.col("amount"))
    if "timestamp" in have:
        parts: dict[str, Column] = scalar.calendar_parts(F.col("timestamp"))
        out.update(parts)
        out.update(scalar.cyclical_time(parts["hour_of_day"], parts["day_of_week"], parts["month"]))
    if "is_fraud" in have:
        out["fraud_label"] = F.col("is_fraud").cast("int")
    if "velocity_score" in have:
        out["velocity_score_norm"] = scalar.velocity_score_norm(F.col("velocity_score"))
    if "geo_anomaly_score" in have:
        out["geo_anomaly_bin"] = scalar.geo_anomaly_bin(F.col("geo_anomaly_score"))
    if {"device_used", "payment_channel"} <= have:
        out["device_channel"] = scalar.device_channel(F.col("device_used"), F.col("payment_channel"))
    if "spending_deviation_score" in have:
        out["spending_risk"] = scalar.spending_risk(F.col("spending_deviation_score"))
    return df.withColumns(out)


def engineer_features(df: DataFrame) -> DataFrame:
    """Cleaning, row-wise features, per-account history: one exchange on the account in all."""
    cleaned = df
    if "timestamp" in df.columns:
        cleaned = clean.cast_timestamp(cleaned)
    cleaned = clean.drop_null_keys(cleaned)
    featured = scalar_features(cleaned)
    if {"sender_account", "timestamp", "amount", "transaction_id"} <= set(df.columns):
        featured = account_history(featured)
    return featured


def feature_job(spark: SparkSession, source: str, target: str) -> None:
    """Raw file to feature table: a single write is the only action on the data."""
    sink_parquet(engineer_features(scan_table(spark, source)), target)


def risk_by_category(features: DataFrame) -> DataFrame:
    """How many transactions of each category carry which spending risk, and how unusual they are."""
    return features.groupBy("merchant_category", "spending_risk").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("fraud_label").alias("frauds"),
        F.avg("amount").alias("avg_amount"),
        F.avg("amount_deviation_from_avg").alias("avg_deviation"),
        F.avg("tx_velocity").alias("avg_velocity"),
    )


@dataclass(frozen=True)
class Trained:
    """What a training run leaves behind; ``scoring`` is all that a scorer needs."""

    model: Model
    features: list[str]
    threshold: float
    metrics: DataFrame
    scoring: ScoringSet
    #: Evaluation of the anomaly half; None without a reconstructor.
    anomaly_metrics: DataFrame | None = None


#: Re-sampling operators by the names they take the label, row id and feature array under.
ARRAY_TECHNIQUES = ("smote", "adasyn", "borderline_smote", "cluster_smote")


def resampled(train: DataFrame, technique: str | None, row_id: str = "id", **options) -> DataFrame:
    """``train(id, label, features)`` re-balanced by technique name, or as it is with None or "none".

    Techniques with a target do nothing where the minority is already there.
    """
    if technique in (None, "none"):
        return train
    if technique in ARRAY_TECHNIQUES:
        out = sampling.rebalance(train, technique, label="label", row_id=row_id, features="features", **options)
    else:
        out = sampling.rebalance(train, technique, label="label", row_id=row_id, **options)
    return out.select(row_id, "label", "features")


def fit_anomaly_half(train: DataFrame, val: DataFrame, axes: int, percentile: float = 95.0) -> tuple[models.Reconstructor, float]:
    """(reconstructor of the normal training rows, the percentile of the normal validation rows' errors)."""
    rebuilt = models.train_reconstructor(train, axes)
    errors = scoring.anomaly_score(rebuilt.transform(val), "scaled", "rebuilt")
    cut = evaluation.fit_anomaly_threshold(errors, "anomaly_score", "label", percentile).first()["threshold"]
    return rebuilt, float(scoring.DEFAULT_ANOMALY_CUT if cut is None else cut)


def training_job(
    table: DataFrame, row_id: str = "transaction_id", label: str = "fraud_label", kind: str = "logistic",
    features: Sequence[str] | None = None, technique: str | None = None, loss: str | None = None, anomaly_axes: int = 0,
    class_weight_ratio: float | None = None, **sampling_options,
) -> Trained:
    """Split, impute, scale, re-sample, fit, pick the F1-best cut, measure on held-out rows; both halves.

    Imputation, scaling and re-sampling see the training rows only. ``technique`` is a name of ``sampling.TECHNIQUES``;
    ``loss`` trains a linear model on a loss of ``evaluation`` by name; otherwise rows are weighed by class, balanced or
    1 to ``class_weight_ratio``. With ``anomaly_axes`` a reconstructor of the normal rows is fitted too, and its cut
    is the 95th percentile of the normal validation rows. The chosen columns are written to the shared checkpoint
    folder once: every later pass reads that copy.
    """
    names = list(features or clean.feature_names(table.schema))
    ensure_checkpoint_dir(table.sparkSession)
    stored = table.select(row_id, label, *names).checkpoint()
    split = prep.split_stratified(stored, label, row_id)
    train = split.filter(F.col("split") == "train")
    medians = clean.column_quantiles(train, names, [0.5])
    filled = train.withColumns({c: F.coalesce(scalar.null_if_nan(F.col(c)), F.lit((medians.get(c) or [0.0])[0])) for c in names})
    prepared = preparation(train, names, medians, prep.fit_scaler(filled, names))
    assembled = prepared.prepare(split).select(F.col(row_id).alias("id"), F.col(label).alias("label"), "split", "features")
    parts = {s: assembled.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    fit_rows = resampled(parts["train"], technique, **sampling_options)
    if technique not in (None, "none"):
        # Read by every pass of the fit; made once.
        fit_rows, _ = ordering.stored(fit_rows)
    if loss is not None:
        model: Model | Linear = models.train_loss(fit_rows, loss)
    elif kind in ("logistic", "gbt"):
        model = models.train_weighted(fit_rows, kind, ratio=class_weight_ratio)
    else:
        model = models.train_classifier(fit_rows, kind)
    chosen = replace(prepared, classifier=linear_part(model))
    if anomaly_axes:
        rebuilt, anomaly_cut = fit_anomaly_half(parts["train"], parts["val"], anomaly_axes)
        chosen = replace(chosen, reconstructor=rebuilt, anomaly_cut=anomaly_cut)
    held_out = chosen.score(split.filter(F.col("split") != "train").drop("features"))
    val, test = (held_out.filter(F.col("split") == s) for s in ("val", "test"))
    cut = evaluation.best_f1_threshold(val, "fraud_probability", label).first()["threshold"]
    chosen = replace(chosen, probability_cut=float(cut))
    flagged = test.withColumn("predicted", (F.col("fraud_probability") >= F.lit(cut)).cast("int"))
    anomalies = None
    if anomaly_axes:
        by_error = test.withColumn("predicted", (F.col("anomaly_score") >= F.lit(chosen.anomaly_cut)).cast("int"))
        anomalies = evaluation.binary_metrics(by_error, label, "predicted")
    return Trained(model, names, cut, evaluation.binary_metrics(flagged, label, "predicted"), chosen, anomalies)
