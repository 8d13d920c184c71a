"""The benchmark tables seen as transactions (and the same view as SQL, for the oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions: a user is an account, an error event is a fraud."""
    k = F.col("k")
    fraud = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select(
            F.col("event_id").alias("transaction_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("user_id").alias("sender_account"),
            (F.col("user_id") + k).alias("receiver_account"),
            F.col("value").alias("amount"),
            F.col("event_type").alias("transaction_type"),
            F.concat(F.lit("m"), (k % 12).cast("string")).alias("merchant_category"),
            F.when(k >= 5, F.concat(F.lit("dev"), (k % 4).cast("string"))).alias("device_used"),
            F.concat(F.lit("ch"), (k % 3).cast("string")).alias("payment_channel"),
            fraud.alias("is_fraud"),
            F.when(fraud, F.concat(F.lit("ft"), (k % 3).cast("string"))).alias("fraud_type"),
            F.when(k % 10 != 0, k * F.lit(60.0)).alias("time_since_last_transaction"),
            F.when(k % 19 != 0, k / F.lit(50.0)).alias("spending_deviation_score"),
            k.cast("double").alias("velocity_score"),
            F.when(k % 17 != 0, k / F.lit(100.0)).alias("geo_anomaly_score"),
        )
    )


TX_SQL = """
kx AS (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events),
tx AS (
  SELECT event_id AS transaction_id, ts AS timestamp, user_id AS sender_account,
         user_id + k AS receiver_account, value AS amount, event_type AS transaction_type,
         'm' || (k % 12)::VARCHAR AS merchant_category,
         CASE WHEN k >= 5 THEN 'dev' || (k % 4)::VARCHAR END AS device_used,
         'ch' || (k % 3)::VARCHAR AS payment_channel,
         event_type = 'error' AS is_fraud,
         CASE WHEN event_type = 'error' THEN 'ft' || (k % 3)::VARCHAR END AS fraud_type,
         CASE WHEN k % 10 <> 0 THEN k * 60.0::DOUBLE END AS time_since_last_transaction,
         CASE WHEN k % 19 <> 0 THEN k / 50.0::DOUBLE END AS spending_deviation_score,
         k::DOUBLE AS velocity_score,
         CASE WHEN k % 17 <> 0 THEN k / 100.0::DOUBLE END AS geo_anomaly_score
  FROM kx)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a probability and an anomaly score any engine can recompute."""
    amount = F.col("amount")
    return transactions(spark, sf_dir).select(
        "transaction_id",
        "timestamp",
        "merchant_category",
        "amount",
        F.col("is_fraud").cast("int").alias("label"),
        (amount / (amount + 50.0)).alias("probability"),
        (amount * amount / 1000.0).alias("anomaly_score"),
    )


SCORED_SQL = (
    TX_SQL
    + """,
scored AS (
  SELECT transaction_id, timestamp, merchant_category, amount, is_fraud::INTEGER AS label,
         amount / (amount + 50.0::DOUBLE) AS probability,
         amount * amount / 1000.0::DOUBLE AS anomaly_score
  FROM tx)"""
)


_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a second, larger transaction table: the customer is the account."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_KEY, "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        # (order, line number) repeats in this data; with part, supplier and price it does not.
        F.concat_ws("-", *_LINE_KEY, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").alias("sender_account"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").alias("is_fraud"),
    )


LEDGER_SQL = """
ledger AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS transaction_id, o_orderdate AS timestamp,
         o_custkey AS sender_account, l_extendedprice AS amount, l_quantity AS quantity,
         l_discount AS discount, l_tax AS tax, l_returnflag = 'R' AS is_fraud
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def vectors(spark: SparkSession, sf_dir: str, positive: int = 1) -> DataFrame:
    """``embeddings`` as a feature matrix with a rare class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == positive).cast("int").alias("label"),
    )


VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, (label = 1)::INTEGER AS label
  FROM embeddings)"""
