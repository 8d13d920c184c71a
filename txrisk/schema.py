"""Canonical schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("sender_account", T.StringType()),
        T.StructField("receiver_account", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("device_used", T.StringType()),
        T.StructField("payment_channel", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("device_hash", T.StringType()),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("time_since_last_transaction", T.DoubleType()),
        T.StructField("spending_deviation_score", T.DoubleType()),
        T.StructField("velocity_score", T.DoubleType()),
        T.StructField("geo_anomaly_score", T.DoubleType()),
    ]
)

STREAM_RECORD = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("sender_account", T.StringType()),
        T.StructField("receiver_account", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
    ]
)

# Columns that identify a row or an account and are never features.
ID_COLUMNS = (
    "transaction_id",
    "sender_account",
    "receiver_account",
    "ip_address",
    "device_hash",
)
# Every column that carries the label.
LABEL_COLUMNS = ("is_fraud", "fraud_label")


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(schema: T.StructType) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]
