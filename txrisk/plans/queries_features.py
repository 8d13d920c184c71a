"""Queries: sources, cleaning, alignment, scalar features, windows, joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.datasets import LEDGER_SQL, TX_SQL, ledger, table, transactions
from txrisk.functions import random, scalar, vectors
from txrisk.operators import aggregate, align, clean, sequence, velocity
from txrisk.plans import pipeline
from txrisk.plans.registry import R, query, r, rand_sql, rounded
from txrisk.session import scratch_path, settings
from txrisk.sources import files, synthetic


def _tx(sql: str) -> str:
    return f"WITH {TX_SQL} {sql}"


def _led(sql: str) -> str:
    return f"WITH {LEDGER_SQL} {sql}"


RAW = ["transaction_id", "sender_account", "amount", "transaction_type", "device_used", "is_fraud", "velocity_score"]
RAW_SQL = ", ".join(RAW)


# ---- sources and sinks -----------------------------------------------------------------


def _round_trip(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """Write the transactions in a format, read them back with an explicit schema."""
    raw = transactions(spark, d).select(*RAW)
    path = f"{scratch_path(spark, 'tx')}.{fmt}"
    files.sink_table(raw, path, fmt)
    return files.scan_table(spark, path, schema=raw.schema)


@query("scan_csv", _tx(f"SELECT {RAW_SQL} FROM tx"))
def _(spark, d):
    raw = transactions(spark, d).select(*RAW)
    path = scratch_path(spark, "tx-csv")
    files.sink_table(raw, path, "csv")
    return files.scan_csv(spark, path, raw.schema)


@query("scan_csv_reordered", _tx(f"SELECT {RAW_SQL} FROM tx"))
def _(spark, d):
    """Files with another column order, a column more, and labels written 0 and 1."""
    raw = transactions(spark, d).select(*RAW)
    path = scratch_path(spark, "tx-csv")
    other = raw.select(F.lit("x").alias("note"), *reversed(RAW)).withColumn("is_fraud", F.col("is_fraud").cast("int"))
    files.sink_table(other, path, "csv")
    return files.scan_csv(spark, path, raw.schema)


@query("scan_table", _tx(f"SELECT {RAW_SQL} FROM tx"))
def _(spark, d):
    return _round_trip(spark, d, "json")


@query("sink_parquet", _tx(f"SELECT {RAW_SQL} FROM tx"))
def _(spark, d):
    raw = transactions(spark, d).select(*RAW)
    path = scratch_path(spark, "tx-parquet")
    files.sink_parquet(raw, path)
    return files.scan_table(spark, path, "parquet")


@query("sink_table", _tx(f"SELECT {RAW_SQL} FROM tx"))
def _(spark, d):
    return _round_trip(spark, d, "csv")


@query(
    "sink_metrics",
    _tx(
        f"""SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM tx
        UNION ALL SELECT 'mean_amount', {R('avg(amount)')} FROM tx
        UNION ALL SELECT 'fraud_rate', {R('avg(is_fraud::INTEGER)')} FROM tx"""
    ),
)
def _(spark, d):
    one = transactions(spark, d).agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        r(F.avg("amount")).alias("mean_amount"),
        r(F.avg(F.col("is_fraud").cast("int"))).alias("fraud_rate"),
    )
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))
    path = scratch_path(spark, "metrics")
    files.sink_metrics(long, path)
    return spark.read.schema("metric string, value double").json(path)


@query(
    "synthetic_transactions",
    f"""SELECT 'TX' || event_id AS transaction_id,
      CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) - CAST(floor({rand_sql('event_id', 'time')} * 2592000) AS BIGINT) AS seconds,
      {R(rand_sql('event_id', 'amount') + ' * 10000')} AS amount,
      'SENDER' || CAST(floor({rand_sql('event_id', 'sender')} * 1000) AS INTEGER) AS sender_account,
      'RECEIVER' || CAST(floor({rand_sql('event_id', 'receiver')} * 1000) AS INTEGER) AS receiver_account,
      CASE CAST(floor({rand_sql('event_id', 'type')} * 4) AS INTEGER)
        WHEN 0 THEN 'PAYMENT' WHEN 1 THEN 'TRANSFER' WHEN 2 THEN 'WITHDRAWAL' ELSE 'DEPOSIT' END AS transaction_type,
      {rand_sql('event_id', 'fraud')} < 0.05 AS is_fraud
    FROM events""",
)
def _(spark, d):
    made = synthetic.synthesize_from(table(spark, d, "events"), "event_id")
    return rounded(made.withColumn("seconds", F.unix_seconds("timestamp")).drop("timestamp"), "amount")


# ---- cleaning --------------------------------------------------------------------------


@query(
    "drop_null_keys",
    _tx(
        """SELECT transaction_id, sender_account, time_since_last_transaction, geo_anomaly_score FROM tx
        WHERE time_since_last_transaction IS NOT NULL AND geo_anomaly_score IS NOT NULL AND sender_account IS NOT NULL"""
    ),
)
def _(spark, d):
    keys = ["time_since_last_transaction", "geo_anomaly_score", "sender_account"]
    return clean.drop_null_keys(transactions(spark, d), keys).select("transaction_id", *keys)


@query(
    "cast_timestamp",
    """SELECT event_id, epoch_us(CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END) AS us FROM events""",
)
def _(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.col("ts").cast("string"))
    casted = clean.cast_timestamp(table(spark, d, "events").select("event_id", text.alias("timestamp")))
    return casted.select("event_id", F.unix_micros("timestamp").alias("us"))


@query("label_from_bool", _tx("SELECT transaction_id, is_fraud::INTEGER AS fraud_label FROM tx"))
def _(spark, d):
    return clean.label_from_bool(transactions(spark, d)).select("transaction_id", "fraud_label")


@query("target_resolution", _tx("SELECT transaction_id, is_fraud::INTEGER AS target FROM tx"))
def _(spark, d):
    return clean.target_resolution(transactions(spark, d)).select("transaction_id", "target")


_TX_KINDS = {
    "transaction_id": "numeric", "timestamp": "datetime", "sender_account": "numeric", "receiver_account": "numeric",
    "amount": "numeric", "transaction_type": "categorical", "merchant_category": "categorical",
    "device_used": "categorical", "payment_channel": "categorical", "is_fraud": "other", "fraud_type": "categorical",
    "time_since_last_transaction": "numeric", "spending_deviation_score": "numeric", "velocity_score": "numeric",
    "geo_anomaly_score": "numeric",
}


@query(
    "column_types",
    _tx(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS non_null FROM tx" for c, k in _TX_KINDS.items()
        )
    ),
)
def _(spark, d):
    return clean.column_types(transactions(spark, d))


FEATURES = ["amount", "time_since_last_transaction", "spending_deviation_score", "velocity_score", "geo_anomaly_score"]


@query("select_features", _tx(f"SELECT transaction_id, {', '.join(FEATURES)} FROM tx"))
def _(spark, d):
    return clean.select_features(transactions(spark, d), ["transaction_id"])


GAPPY = ["time_since_last_transaction", "spending_deviation_score", "geo_anomaly_score"]


@query(
    "impute_mean",
    _tx(
        "SELECT transaction_id, "
        + ", ".join(f"{R(f'coalesce({c}, avg({c}) OVER ())')} AS {c}" for c in GAPPY)
        + " FROM tx"
    ),
)
def _(spark, d):
    filled = clean.impute_mean(transactions(spark, d), GAPPY)
    return rounded(filled.select("transaction_id", *GAPPY), *GAPPY)


@query("impute_zero", _tx("SELECT transaction_id, " + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in GAPPY) + " FROM tx"))
def _(spark, d):
    return clean.impute_zero(transactions(spark, d), GAPPY).select("transaction_id", *GAPPY)


@query(
    "impute_median",
    _tx(
        "SELECT transaction_id, "
        + ", ".join(f"{R(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM tx))')} AS {c}" for c in GAPPY)
        + " FROM tx"
    ),
)
def _(spark, d):
    filled = clean.impute_median(transactions(spark, d), GAPPY)
    return rounded(filled.select("transaction_id", *GAPPY), *GAPPY)


@query(
    "impute_mode",
    _tx(
        """SELECT transaction_id, coalesce(device_used, (SELECT device_used FROM tx WHERE device_used IS NOT NULL
          GROUP BY device_used ORDER BY count(*) DESC, device_used LIMIT 1)) AS device_used FROM tx"""
    ),
)
def _(spark, d):
    return clean.impute_mode(transactions(spark, d), ["device_used"]).select("transaction_id", "device_used")


@query(
    "impute_eval",
    _tx(
        f"""SELECT transaction_id,
        {R('coalesce(geo_anomaly_score, (SELECT quantile_cont(geo_anomaly_score, 0.5) FROM tx))')} AS geo_anomaly_score,
        0.0::DOUBLE AS amount_delta, amount AS avg_amount, 0.0::DOUBLE AS other FROM tx"""
    ),
)
def _(spark, d):
    nothing = F.lit(None).cast("double")
    base = transactions(spark, d).select("transaction_id", "amount", "geo_anomaly_score").withColumns(
        {"amount_delta": nothing, "avg_amount": nothing, "other": nothing}
    )
    filled = clean.impute_eval(base, ["geo_anomaly_score", "amount_delta", "avg_amount", "other"])
    return rounded(filled.drop("amount"), "geo_anomaly_score")


@query(
    "default_tx_frequency",
    _tx(
        f"""SELECT transaction_id, {R('CASE WHEN time_since_last_transaction > 0 THEN 86400.0 / time_since_last_transaction ELSE 1.0 END')}
        AS transaction_frequency FROM tx"""
    ),
)
def _(spark, d):
    out = clean.default_tx_frequency(transactions(spark, d))
    return rounded(out.select("transaction_id", "transaction_frequency"), "transaction_frequency")


@query(
    "common_features",
    _tx(
        """SELECT 'amount' AS feature, count(amount) AS reference_values,
          (SELECT count(amount) FROM tx WHERE timestamp >= TIMESTAMP '2024-01-16') AS production_values, true AS common
        FROM tx WHERE timestamp < TIMESTAMP '2024-01-16'
        UNION ALL SELECT 'velocity_score', count(velocity_score), NULL, false FROM tx WHERE timestamp < TIMESTAMP '2024-01-16'
        UNION ALL SELECT 'unknown', NULL, NULL, false"""
    ),
)
def _(spark, d):
    tx, cut = transactions(spark, d), F.lit("2024-01-16").cast("timestamp")
    old, new = tx.filter(F.col("timestamp") < cut), tx.filter(F.col("timestamp") >= cut).drop("velocity_score")
    return clean.common_features(old, new, ["amount", "velocity_score", "unknown"])


# ---- alignment -------------------------------------------------------------------------

_WANTED = ["amount", "amount_log", "transaction_frequency", "velocity_score_norm", "hour_of_day"]


@query(
    "align_features_default",
    _tx(
        f"""SELECT transaction_id, amount, {R('ln(1 + amount)')} AS amount_log,
        {R('CASE WHEN time_since_last_transaction > 0 THEN 86400.0 / time_since_last_transaction ELSE 1.0 END')} AS transaction_frequency,
        {R('velocity_score / 100')} AS velocity_score_norm, 0.0::DOUBLE AS hour_of_day FROM tx"""
    ),
)
def _(spark, d):
    out = align.align_features_default(transactions(spark, d), _WANTED, ["transaction_id"])
    return rounded(out, "amount_log", "transaction_frequency", "velocity_score_norm")


@query(
    "align_features_strict",
    _tx(
        """SELECT transaction_id, velocity_score, geo_anomaly_score, amount FROM tx
        WHERE velocity_score IS NOT NULL AND geo_anomaly_score IS NOT NULL AND amount IS NOT NULL"""
    ),
)
def _(spark, d):
    names = ["velocity_score", "geo_anomaly_score", "amount"]
    strict = align.align_features_strict(transactions(spark, d), names, ["transaction_id"])
    return align.split_incomplete(strict, names)[0]


@query(
    "align_features_strict_rejects",
    _tx("SELECT transaction_id FROM tx WHERE velocity_score IS NULL OR geo_anomaly_score IS NULL OR amount IS NULL"),
)
def _(spark, d):
    names = ["velocity_score", "geo_anomaly_score", "amount"]
    return align.split_incomplete(transactions(spark, d), names)[1].select("transaction_id")


@query(
    "align_features_eval",
    """WITH b AS (SELECT o_orderkey, o_orderdate AS timestamp, o_totalprice AS amount,
      CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice / 2 END AS old_b, c_acctbal AS new_b,
      CASE WHEN o_orderkey % 3 <> 0 THEN c_acctbal + 1 END AS dest_b
      FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, hour(timestamp) AS hour, amount,
      """
    + R("list_aggregate(list_filter([old_b, new_b, dest_b], lambda x: x IS NOT NULL), 'median')")
    + f""" AS balance_mid, {R('amount - old_b')} AS amount_delta,
      {R('amount / CASE WHEN old_b = 0 THEN 1.0 ELSE old_b END')} AS amount_ratio,
      0.0::DOUBLE AS time_since_x, amount AS avg_amount, 0.0::DOUBLE AS other FROM b""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    base = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice") / 2).alias("oldbalanceOrg"),
        F.col("c_acctbal").alias("newbalanceOrig"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("c_acctbal") + 1).alias("oldbalanceDest"),
    )
    names = ["hour", "amount", "balance_mid", "amount_delta", "amount_ratio", "time_since_x", "avg_amount", "other"]
    return rounded(align.align_features_eval(base, names, ["o_orderkey"]), "balance_mid", "amount_delta", "amount_ratio")


@query(
    "conform_to_schema",
    _tx(
        """SELECT transaction_id::VARCHAR AS transaction_id, amount, 0.0::DOUBLE AS balance, NULL::VARCHAR AS country,
        0 AS hour, sender_account::VARCHAR AS sender_account FROM tx"""
    ),
)
def _(spark, d):
    reference = T.StructType(
        [
            T.StructField("transaction_id", T.StringType()), T.StructField("amount", T.DoubleType()),
            T.StructField("balance", T.DoubleType()), T.StructField("country", T.StringType()),
            T.StructField("hour", T.IntegerType()), T.StructField("sender_account", T.StringType()),
        ]
    )
    return align.conform_to_schema(transactions(spark, d), reference)


@query(
    "pad_features",
    f"""SELECT vec_id, len(x) AS width, {R('list_sum(x)')} AS total, x[1] AS first, x[80] AS last FROM (
      SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [0.0::DOUBLE for i in range(16)]) AS x FROM embeddings)""",
)
def _(spark, d):
    padded = table(spark, d, "embeddings").select("vec_id", vectors.pad(F.col("embedding"), 80).alias("x"))
    return padded.select(
        "vec_id",
        F.size("x").alias("width"),
        r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("total"),
        F.get("x", F.lit(0)).alias("first"),
        F.get("x", F.lit(79)).alias("last"),
    )


# ---- scalar features -------------------------------------------------------------------


@query("amount_log", _tx(f"SELECT transaction_id, {R('CASE WHEN amount - 5 > -1 THEN ln(amount - 5 + 1) END')} AS amount_log FROM tx"))
def _(spark, d):
    return transactions(spark, d).select("transaction_id", r(scalar.amount_log(F.col("amount") - 5)).alias("amount_log"))


@query(
    "calendar_parts",
    _tx(
        """SELECT transaction_id, hour(timestamp) AS hour_of_day, dayofweek(timestamp) + 1 AS day_of_week,
        month(timestamp) AS month, year(timestamp) AS year FROM tx"""
    ),
)
def _(spark, d):
    parts = scalar.calendar_parts(F.col("timestamp"))
    return transactions(spark, d).select("transaction_id", *[c.alias(n) for n, c in parts.items()])


def _cycle_sql(hour: str, day: str, month: str, day_period: int, pi: float) -> str:
    out = []
    for name, value, period in (("hour", hour, 24), ("day", day, day_period), ("month", month, 12)):
        for fn in ("sin", "cos"):
            out.append(f"{R(f'{fn}(({value}) * {2.0 * pi / period!r}::DOUBLE)')} AS {name}_{fn}")
    return ", ".join(out)


@query(
    "cyclical_time",
    _tx(
        "SELECT transaction_id, "
        + _cycle_sql("hour(timestamp)", "dayofweek(timestamp) + 1", "month(timestamp)", 7, scalar.SHORT_PI)
        + " FROM tx"
    ),
)
def _(spark, d):
    p = scalar.calendar_parts(F.col("timestamp"))
    cols = scalar.cyclical_time(p["hour_of_day"], p["day_of_week"], p["month"])
    return transactions(spark, d).select("transaction_id", *[r(c).alias(n) for n, c in cols.items()])


@query(
    "cyclical_time_of_month",
    _tx("SELECT transaction_id, " + _cycle_sql("hour(timestamp)", "day(timestamp)", "month(timestamp)", 31, math.pi) + " FROM tx"),
)
def _(spark, d):
    t = F.col("timestamp")
    cols = scalar.cyclical_time(F.hour(t), F.dayofmonth(t), F.month(t), 31, math.pi)
    return transactions(spark, d).select("transaction_id", *[r(c).alias(n) for n, c in cols.items()])


@query("velocity_score_norm", _tx(f"SELECT transaction_id, {R('velocity_score / 100')} AS velocity_score_norm FROM tx"))
def _(spark, d):
    return transactions(spark, d).select(
        "transaction_id", r(scalar.velocity_score_norm(F.col("velocity_score"))).alias("velocity_score_norm")
    )


@query(
    "geo_anomaly_bin",
    _tx(
        """SELECT transaction_id, CASE WHEN geo_anomaly_score < 0.3 THEN 'low' WHEN geo_anomaly_score < 0.7 THEN 'medium'
        ELSE 'high' END AS geo_anomaly_bin FROM tx"""
    ),
)
def _(spark, d):
    return transactions(spark, d).select("transaction_id", scalar.geo_anomaly_bin(F.col("geo_anomaly_score")).alias("geo_anomaly_bin"))


@query(
    "spending_risk",
    _tx(
        """SELECT transaction_id, CASE WHEN spending_deviation_score > 1.5 THEN 'high'
        WHEN spending_deviation_score > 0.5 THEN 'medium' ELSE 'low' END AS spending_risk FROM tx"""
    ),
)
def _(spark, d):
    return transactions(spark, d).select("transaction_id", scalar.spending_risk(F.col("spending_deviation_score")).alias("spending_risk"))


@query("device_channel", _tx("SELECT transaction_id, device_used || '_' || payment_channel AS device_channel FROM tx"))
def _(spark, d):
    return transactions(spark, d).select(
        "transaction_id", scalar.device_channel(F.col("device_used"), F.col("payment_channel")).alias("device_channel")
    )


@query(
    "time_features",
    _tx(
        """SELECT transaction_id, hour(timestamp) AS ts_hour, day(timestamp) AS ts_day, isodow(timestamp) - 1 AS ts_dayofweek,
        month(timestamp) AS ts_month, year(timestamp) AS ts_year, quarter(timestamp) AS ts_quarter,
        (isodow(timestamp) >= 6)::INTEGER AS ts_is_weekend,
        CASE WHEN hour(timestamp) < 6 THEN 'night' WHEN hour(timestamp) < 12 THEN 'morning'
             WHEN hour(timestamp) < 18 THEN 'afternoon' ELSE 'evening' END AS ts_time_of_day FROM tx"""
    ),
)
def _(spark, d):
    cols = scalar.time_features(F.col("timestamp"), "ts")
    return transactions(spark, d).select("transaction_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "amount_features",
    _tx(
        f""", c AS (SELECT transaction_id, greatest(amount - 10, 0.0::DOUBLE) AS a FROM tx),
        q AS (SELECT min(a) AS low, quantile_cont(a, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS qs FROM c),
        e AS (SELECT list_distinct(list_filter(qs, lambda x: x > low)) AS edges FROM q)
        SELECT transaction_id, {R('ln(1 + a)')} AS v_log, len(list_filter(edges, lambda x: x < a))::INTEGER AS v_bin FROM c, e"""
    ),
)
def _(spark, d):
    base = transactions(spark, d).select("transaction_id", (F.col("amount") - 10).alias("v"))
    return rounded(aggregate.amount_features(base, "v").drop("v"), "v_log")


# ---- windows ---------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY sender_account ORDER BY timestamp, transaction_id), w5 AS (PARTITION BY sender_account ORDER BY timestamp, transaction_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_SEC = "CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT)"
_SPAN = f"CASE WHEN min({_SEC}) OVER w5 IS NOT NULL THEN ({_SEC} - min({_SEC}) OVER w5) / 86400.0::DOUBLE ELSE 1.0::DOUBLE END"
_CNT = "count(amount) OVER w5"
HISTORY_SQL = {
    "time_since_prev_tx": f"({_SEC} - lag({_SEC}) OVER w) / 60.0::DOUBLE",
    "amount_delta": "amount - lag(amount) OVER w",
    "amount_ratio": "CASE WHEN lag(amount) OVER w > 0 THEN amount / lag(amount) OVER w END",
    "avg_amount_last5": "avg(amount) OVER w5",
    "max_amount_last5": "max(amount) OVER w5",
    "tx_count_last5": _CNT,
    "time_span_days": _SPAN,
    "transaction_frequency": f"CASE WHEN ({_SPAN}) > 0 THEN {_CNT} / ({_SPAN}) ELSE {_CNT} END",
    "amount_deviation_from_avg": "CASE WHEN avg(amount) OVER w5 IS NOT NULL THEN (amount - avg(amount) OVER w5) / nullif(avg(amount) OVER w5, 0) ELSE 0 END",
    "tx_velocity": f"{_CNT} / 5.0::DOUBLE",
}


def _history_query(names: list[str]):
    def run(spark, d):
        out = sequence.account_history(ledger(spark, d), names).select("transaction_id", *names)
        return rounded(out, *names)

    return run


def history_sql(names: list[str], relation: str = "ledger") -> str:
    cols = ", ".join(f"{R(HISTORY_SQL[n])} AS {n}" for n in names)
    return (_led if relation == "ledger" else _tx)(f"SELECT transaction_id, {cols} FROM {relation} {_W}")


for _name, _cols in {
    "time_since_prev_tx": ["time_since_prev_tx"],
    "amount_delta": ["amount_delta"],
    "amount_ratio": ["amount_ratio"],
    "rolling_last5": ["avg_amount_last5", "max_amount_last5", "tx_count_last5"],
    "time_span_days": ["time_span_days"],
    "transaction_frequency": ["transaction_frequency"],
    "amount_deviation_from_avg": ["amount_deviation_from_avg"],
    "tx_velocity": ["tx_velocity"],
    "account_history": list(HISTORY_SQL),
}.items():
    query(_name, history_sql(_cols))(_history_query(_cols))


@query(
    "entity_time_diff",
    _tx(
        f"""SELECT transaction_id, {R('(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 3.6e9')} AS sender_account_time_diff
        FROM tx {_W}"""
    ),
)
def _(spark, d):
    out = sequence.entity_time_diff(transactions(spark, d), "sender_account", "timestamp", "transaction_id")
    return rounded(out.select("transaction_id", "sender_account_time_diff"), "sender_account_time_diff")


def _velocity_sql(windows: list[int]) -> str:
    cols, frames = [], []
    for w in windows:
        frames.append(
            f"f{w} AS (PARTITION BY sender_account ORDER BY epoch_us(timestamp) RANGE BETWEEN {w * scalar.MICROS_PER_DAY} PRECEDING AND 1 PRECEDING)"
        )
        cols += [
            f"count(*) OVER f{w} AS sender_account_txn_count_{w}d",
            f"{R(f'coalesce(sum(amount) OVER f{w}, 0)', 4)} AS sender_account_amount_sum_{w}d",
            f"{R(f'avg(amount) OVER f{w}', 4)} AS sender_account_amount_mean_{w}d",
        ]
    diff = R("(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY sender_account ORDER BY timestamp, transaction_id)) / 3.6e9")
    return f"SELECT transaction_id, {diff} AS sender_account_time_diff, {', '.join(cols)} FROM {{src}} WINDOW {', '.join(frames)}"


def _velocity_run(source, windows):
    def run(spark, d):
        out = velocity.velocity_features(source(spark, d), "sender_account", "timestamp", "transaction_id", "amount", windows)
        names = [f"sender_account_amount_{a}_{w}d" for w in windows for a in ("sum", "mean")]
        counts = [f"sender_account_txn_count_{w}d" for w in windows]
        slim = out.select("transaction_id", "sender_account_time_diff", *counts, *names)
        return rounded(rounded(slim, *names, digits=4), "sender_account_time_diff")

    return run


def _all_large(run):
    """The same query with every entity above the sliding-frame limit; the answer may not depend on it."""

    def forced(spark, d):
        with settings(spark, {velocity.RANGE_FRAME_ROWS_CONF: 1}):
            return run(spark, d)

    return forced


query("velocity_features_large", _tx(_velocity_sql([1, 7, 30]).format(src="tx")))(_all_large(_velocity_run(transactions, [1, 7, 30])))
query("velocity_features", _tx(_velocity_sql([1, 7, 30]).format(src="tx")))(_velocity_run(transactions, [1, 7, 30]))
query("velocity_features_ledger", _led(_velocity_sql([30, 90]).format(src="ledger")))(_velocity_run(ledger, [30, 90]))


_ROLLING_SQL = _tx(
    f"""SELECT transaction_id, {R('avg(amount) OVER f')} AS sender_account_amount_7d_mean,
        {R('stddev_samp(amount) OVER f', 4)} AS sender_account_amount_7d_std, count(amount) OVER f AS sender_account_amount_7d_count
        FROM tx WINDOW f AS (PARTITION BY sender_account ORDER BY epoch_us(timestamp)
          RANGE BETWEEN {7 * scalar.MICROS_PER_DAY - 1} PRECEDING AND CURRENT ROW)"""
)


def _rolling_run(spark, d):
    out = velocity.rolling_time_aggs(transactions(spark, d), "sender_account", "amount", "timestamp", [7])
    slim = out.select("transaction_id", *[f"sender_account_amount_7d_{a}" for a in ("mean", "std", "count")])
    return rounded(rounded(slim, "sender_account_amount_7d_mean"), "sender_account_amount_7d_std", digits=4)


query("rolling_time_aggs", _ROLLING_SQL)(_rolling_run)
query("rolling_time_aggs_large", _ROLLING_SQL)(_all_large(_rolling_run))


query(
    "join_rolling",
    _tx(
        f"""SELECT transaction_id, {R('avg(amount) OVER a')} AS transaction_type_amount_1d_mean,
        count(amount) OVER a AS transaction_type_amount_1d_count, {R('avg(amount) OVER b')} AS sender_account_amount_1d_mean,
        count(amount) OVER b AS sender_account_amount_1d_count FROM tx
        WINDOW a AS (PARTITION BY transaction_type ORDER BY epoch_us(timestamp) RANGE BETWEEN {scalar.MICROS_PER_DAY - 1} PRECEDING AND CURRENT ROW),
               b AS (PARTITION BY sender_account ORDER BY epoch_us(timestamp) RANGE BETWEEN {scalar.MICROS_PER_DAY - 1} PRECEDING AND CURRENT ROW)"""
    ),
)(
    lambda spark, d: rounded(
        velocity.rolling_features(
            transactions(spark, d), ["transaction_type", "sender_account"], ["amount"], "timestamp", [1]
        ).select(
            "transaction_id",
            *[f"{g}_amount_1d_{a}" for g in ("transaction_type", "sender_account") for a in ("mean", "count")],
        ),
        "transaction_type_amount_1d_mean",
        "sender_account_amount_1d_mean",
    )
)

_SEEN = "(row_number() OVER w - 1)"
_DAYS = f"CASE WHEN {_SEEN} > 1 THEN (epoch_us(timestamp) - first(epoch_us(timestamp)) OVER w) / 8.64e10 ELSE 0 END"
_GEN_SQL = {
    "hours_since_prev": "coalesce((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 3.6e9, 24)",
    "hist_delta": "coalesce(amount - lag(amount) OVER w, 0)",
    "hist_ratio": "CASE WHEN lag(amount) OVER w IS NULL THEN 1 ELSE amount / greatest(1.0, lag(amount) OVER w) END",
    "hist_avg_last5": "coalesce(avg(amount) OVER w5, amount)",
    "hist_max_last5": "coalesce(max(amount) OVER w5, amount)",
    "hist_count_last5": "count(amount) OVER w5",
    "hist_span_days": _DAYS,
    "hist_frequency": f"CASE WHEN {_SEEN} > 1 THEN {_SEEN} / greatest(1.0, {_DAYS}) ELSE 0 END",
    "hist_deviation": "coalesce(amount - avg(amount) OVER w5, 0)",
    "hist_velocity": f"CASE WHEN ({_DAYS}) > 0 THEN {_SEEN} / (({_DAYS}) * 24) ELSE 0 END",
}


@query(
    "history_features",
    _tx(f"SELECT transaction_id, {', '.join(f'{R(s)} AS {n}' for n, s in _GEN_SQL.items())} FROM tx {_W}"),
)
def _(spark, d):
    out = sequence.history_features(transactions(spark, d))
    return rounded(out.select("transaction_id", *_GEN_SQL), *_GEN_SQL)


# ---- joins, sets, order ----------------------------------------------------------------


def _stats_sql(group: str, value: str) -> str:
    stem = f"{group}_{value}"
    return (
        f"{R(f'avg({value})')} AS {stem}_mean, {R(f'stddev_samp({value})')} AS {stem}_std, "
        f"min({value}) AS {stem}_min, max({value}) AS {stem}_max, count({value}) AS {stem}_count"
    )


@query("group_stats", _tx(f"SELECT device_used, {_stats_sql('device_used', 'amount')}, {_stats_sql('device_used', 'geo_anomaly_score')} FROM tx GROUP BY device_used"))
def _(spark, d):
    out = aggregate.group_stats(transactions(spark, d), "device_used", ["amount", "geo_anomaly_score"])
    return rounded(out, *[f"device_used_{v}_{a}" for v in ("amount", "geo_anomaly_score") for a in ("mean", "std")])


@query(
    "join_group_stats",
    _tx(
        f""", a AS (SELECT device_used, {_stats_sql('device_used', 'amount')} FROM tx WHERE device_used IS NOT NULL GROUP BY 1),
        b AS (SELECT sender_account, {_stats_sql('sender_account', 'amount')} FROM tx GROUP BY 1)
        SELECT transaction_id, a.* EXCLUDE (device_used), b.* EXCLUDE (sender_account)
        FROM tx LEFT JOIN a USING (device_used) LEFT JOIN b USING (sender_account)"""
    ),
)
def _(spark, d):
    groups = ["device_used", "sender_account"]
    out = aggregate.join_group_stats(transactions(spark, d).select("transaction_id", *groups, "amount"), groups, ["amount"])
    return rounded(out.drop(*groups, "amount"), *[f"{g}_amount_{a}" for g in groups for a in ("mean", "std")])


@query(
    "union_samples",
    _tx("SELECT transaction_id, amount FROM tx WHERE is_fraud UNION ALL SELECT transaction_id, amount FROM tx WHERE NOT is_fraud AND amount > 50"),
)
def _(spark, d):
    tx = transactions(spark, d)
    parts = [tx.filter("is_fraud"), tx.filter((~F.col("is_fraud")) & (F.col("amount") > 50))]
    return aggregate.union_samples([p.select("transaction_id", "amount") for p in parts])


@query(
    "remaining_rows",
    _tx(f"SELECT transaction_id, amount FROM tx WHERE transaction_id NOT IN (SELECT transaction_id FROM tx WHERE {rand_sql('transaction_id', 3)} < 0.5)"),
)
def _(spark, d):
    tx = transactions(spark, d).select("transaction_id", "amount")
    sampled = tx.filter(random.det_rand(F.col("transaction_id"), 3) < 0.5)
    return aggregate.remaining_rows(tx, sampled, "transaction_id")


@query("sort_entity_time", _tx("SELECT sender_account, transaction_id, amount FROM tx ORDER BY sender_account, timestamp, transaction_id"))
def _(spark, d):
    out = sequence.sort_entity_time(transactions(spark, d), "sender_account", "timestamp", "transaction_id")
    return out.select("sender_account", "transaction_id", "amount")


@query(
    "feature_pipeline",
    _tx(
        f""", f AS (SELECT *, CASE WHEN spending_deviation_score > 1.5 THEN 'high' WHEN spending_deviation_score > 0.5 THEN 'medium' ELSE 'low' END AS spending_risk,
          {HISTORY_SQL['amount_deviation_from_avg']} AS dev, {HISTORY_SQL['tx_velocity']} AS vel FROM tx {_W})
        SELECT merchant_category, spending_risk, count(*) AS transactions, sum(is_fraud::INTEGER)::BIGINT AS frauds,
          {R('avg(amount)')} AS avg_amount, {R('avg(dev)')} AS avg_deviation, {R('avg(vel)')} AS avg_velocity
        FROM f GROUP BY 1, 2"""
    ),
)
def _(spark, d):
    report = pipeline.risk_by_category(pipeline.engineer_features(transactions(spark, d)))
    return rounded(report, "avg_amount", "avg_deviation", "avg_velocity")
