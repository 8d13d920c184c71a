"""Turn model outputs into flags, scored rows and alert counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.vectors import linear_score, mean_squared_error

# Decision cuts used when none is given.
DEFAULT_PROBABILITY_CUT = 0.5
DEFAULT_ANOMALY_CUT = 0.1
SCORE_COLUMNS = ("fraud_probability", "anomaly_score", "is_fraud_classification", "is_fraud_anomaly", "is_fraud_ensemble")
MODEL_TYPES = ("classification", "autoencoder", "ensemble", "both")


def score_probability(df: DataFrame, model, output: str = "fraud_probability") -> DataFrame:
    """Class-1 probability of a fitted Spark ML model; the model's own columns are dropped."""
    scored = model.transform(df)
    keep = [c for c in df.columns if c != output]
    return scored.select(*keep, vector_to_array("probability")[1].alias(output))


def score_linear(
    df: DataFrame, columns: Sequence[str], weights: Sequence[float], bias: float, output: str = "fraud_probability"
) -> DataFrame:
    """The same for a linear model, as one code-generated expression."""
    return df.withColumn(output, linear_score([F.col(c) for c in columns], list(weights), bias))


def anomaly_score(df: DataFrame, original: str, rebuilt: str, output: str = "anomaly_score") -> DataFrame:
    return df.withColumn(output, mean_squared_error(F.col(original), F.col(rebuilt)))


def apply_threshold(
    df: DataFrame,
    probability: str = "fraud_probability",
    anomaly: str = "anomaly_score",
    probability_cut: float | Column = DEFAULT_PROBABILITY_CUT,
    anomaly_cut: float | Column | None = None,
) -> DataFrame:
    """Flags: at or above the cut. A model whose score column is absent has no opinion (NULL)."""

    def flag(column: str, cut: float | Column) -> Column:
        limit = cut if isinstance(cut, Column) else F.lit(float(cut))
        return F.col(column) >= limit if column in df.columns else F.lit(None).cast("boolean")

    return df.withColumns(
        {
            "is_fraud_classification": flag(probability, probability_cut),
            "is_fraud_anomaly": flag(anomaly, DEFAULT_ANOMALY_CUT if anomaly_cut is None else anomaly_cut),
        }
    )


def ensemble_or(
    df: DataFrame, first: str = "is_fraud_classification", second: str = "is_fraud_anomaly", output: str = "is_fraud_ensemble"
) -> DataFrame:
    """Fraud if either model says so; no opinion counts as no."""
    return df.withColumn(output, F.coalesce(F.col(first), F.lit(False)) | F.coalesce(F.col(second), F.lit(False)))


def score_output(df: DataFrame, row_id: str = "transaction_id", epoch: int | Column = 0, now: Column | None = None) -> DataFrame:
    """Result layout: id, time, scores, flags, then the remaining input columns.

    A row without id is named by a digest of its input columns, so a replayed batch names it alike (and equal rows
    alike); without time it gets the current one.
    """
    inputs = [c for c in df.columns if c not in (*SCORE_COLUMNS, "epoch")]
    fallback = F.concat(
        F.lit("tx_"), F.hex(F.xxhash64(*inputs) if inputs else F.lit(0)), F.lit("_"),
        (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"),
    )
    ident = F.coalesce(F.col(row_id).cast("string"), fallback) if row_id in df.columns else fallback
    moment = now if now is not None else F.current_timestamp()
    when = F.coalesce(F.col("timestamp"), moment) if "timestamp" in df.columns else moment
    lead = {row_id: ident, "timestamp": when}
    rest = [c for c in df.columns if c not in lead and c not in SCORE_COLUMNS]
    return df.select(*[c.alias(n) for n, c in lead.items()], *[c for c in SCORE_COLUMNS if c in df.columns], *rest)


def score_by_model_type(df: DataFrame, model_type: str, keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """The prediction columns of one model, or of both with their combination."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type: {model_type}")
    columns = {
        "classification": ["fraud_probability", "is_fraud_classification"],
        "autoencoder": ["anomaly_score", "is_fraud_anomaly"],
    }
    both = [*columns["classification"], *columns["autoencoder"], "is_fraud_ensemble"]
    return df.select(*keep, *columns.get(model_type, both))


def alert_summary(df: DataFrame, batch: str = "epoch", flag: str = "is_fraud_ensemble") -> DataFrame:
    """Rows and fraud rows per micro-batch."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag)).alias("fraud_rows"))
