"""Make a table fit a saved feature list or a reference schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import default_tx_frequency, velocity_score_norm


class MissingFeatures(ValueError):
    """A required feature is not in the table."""


def feature_values(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """The features in the saved order: as they are, derived where that can be done, else 0.0."""
    have = set(df.columns)
    derived: dict[str, Column] = {
        "transaction_frequency": default_tx_frequency(
            F.col("time_since_last_transaction") if "time_since_last_transaction" in have else None
        )
    }
    if "amount" in have:
        derived["amount_log"] = F.log1p("amount")
    if "velocity_score" in have:
        derived["velocity_score_norm"] = velocity_score_norm(F.col("velocity_score"))
    return [F.col(f) if f in have else derived.get(f, F.lit(0.0)) for f in features]


def align_features_default(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Serving alignment: derive what can be derived, 0.0 for the rest, in the saved order."""
    return df.select(*keep, *[v.alias(f) for f, v in zip(features, feature_values(df, features))])


def align_features_strict(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Refuse a table that lacks a feature; otherwise put the features in order."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise MissingFeatures(f"missing features: {', '.join(missing)}")
    return df.select(*keep, *features)


def split_incomplete(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Row-level form of the strict check: (complete rows, rejected rows)."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    return df.filter(complete), df.filter(~complete)


def _row_median(columns: Sequence[str]) -> Column:
    values = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in columns])))
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _eval_default(df: DataFrame, feature: str) -> Column:
    have, name = df.columns, feature.lower()
    if feature == "hour":
        return F.hour("timestamp") if "timestamp" in have else F.lit(12)
    if "balance" in name:
        others = [c for c in have if "balance" in c.lower()]
        return _row_median(others) if others else F.lit(0.0)
    if name == "amount":
        other_case = [c for c in have if c.lower() == "amount"]
        return F.col(other_case[0]) if other_case else F.lit(0.0)
    if "delta" in name or "ratio" in name:
        if {"amount", "oldbalanceOrg"} <= set(have):
            if feature == "amount_delta":
                return F.col("amount") - F.col("oldbalanceOrg")
            if feature == "amount_ratio":
                return F.col("amount") / F.when(F.col("oldbalanceOrg") == 0, 1.0).otherwise(F.col("oldbalanceOrg"))
        return F.lit(0.0)
    if "time_since" not in name and ("avg_" in name or "max_" in name):
        base = feature.split("_")[1]
        if base in have:
            return F.col(base)
    return F.lit(0.0)


def align_features_eval(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Evaluation alignment: each missing feature gets a default that fits its name."""
    return df.select(
        *keep,
        *[F.col(f) if f in df.columns else _eval_default(df, f).alias(f) for f in features],
    )


def conform_to_schema(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Columns, order and types of ``reference``; what is missing is NULL text or zero."""

    def default(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.NumericType):
            return F.lit(0).cast(field.dataType)
        if isinstance(field.dataType, T.BooleanType):
            return F.lit(False)
        return F.lit(None).cast(field.dataType)

    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else default(f)).alias(f.name)
            for f in reference.fields
        ]
    )
