"""Stand-in transactions when there is no input yet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.random import det_choice, det_rand

# The stand-in table's shape.
ACCOUNTS = 1000
MAX_AMOUNT = 10_000.0
DAYS = 30
FRAUD_SHARE = 0.05
TYPES = ("PAYMENT", "TRANSFER", "WITHDRAWAL", "DEPOSIT")


def synthesize_from(ids: DataFrame, row_id: str, until: str = "2024-01-31 00:00:00") -> DataFrame:
    """One made-up transaction per given id, a pure function of the id."""
    i = F.col(row_id)
    kinds = F.array(*[F.lit(t) for t in TYPES])
    seconds = F.floor(det_rand(i, "time") * (DAYS * 86_400)).cast("int")
    end = F.lit(until).cast("timestamp")
    fraud = det_rand(i, "fraud") < FRAUD_SHARE
    return ids.select(
        F.concat(F.lit("TX"), i.cast("string")).alias("transaction_id"),
        (end - F.make_interval(secs=seconds)).alias("timestamp"),
        (det_rand(i, "amount") * MAX_AMOUNT).alias("amount"),
        F.concat(F.lit("SENDER"), det_choice(i, "sender", ACCOUNTS).cast("string")).alias("sender_account"),
        F.concat(F.lit("RECEIVER"), det_choice(i, "receiver", ACCOUNTS).cast("string")).alias("receiver_account"),
        F.get(kinds, det_choice(i, "type", len(TYPES))).alias("transaction_type"),
        fraud.alias("is_fraud"),
    )


def synthetic_transactions(spark: SparkSession, rows: int = 1000, until: str = "2024-01-31 00:00:00") -> DataFrame:
    parts = max(1, math.ceil(rows / 1_000_000))
    return synthesize_from(spark.range(0, rows, 1, parts), "id", until)
