"""Hand-made edge cases of the row-wise and per-account features."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from txrisk.functions import scalar, vectors
from txrisk.operators import align, clean, sequence, velocity
from txrisk.operators.aggregate import amount_features
from txrisk.plans import pipeline

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def tx(spark, rows):
    """rows: (id, account, seconds after T0, amount)"""
    data = [(i, a, T0 + dt.timedelta(seconds=s), float(v) if v is not None else None) for i, a, s, v in rows]
    return spark.createDataFrame(data, "transaction_id long, sender_account string, timestamp timestamp, amount double")


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_single_row_account(spark):
    r = by_id(sequence.account_history(tx(spark, [(1, "a", 0, 5)])))[1]
    assert r["time_since_prev_tx"] is None and r["amount_delta"] is None and r["amount_ratio"] is None
    assert r["time_span_days"] == 1.0 and r["transaction_frequency"] == 0.0
    assert r["amount_deviation_from_avg"] == 0.0 and r["tx_count_last5"] == 0


def test_tied_times_go_by_id(spark):
    out = by_id(sequence.account_history(tx(spark, [(3, "a", 0, 9), (1, "a", 0, 5), (2, "a", 0, 7)])))
    assert [out[i]["tx_count_last5"] for i in (1, 2, 3)] == [0, 1, 2]
    assert out[1]["time_span_days"] == 1.0 and out[2]["time_span_days"] == 0.0
    assert out[3]["transaction_frequency"] == 2.0 and out[3]["amount_delta"] == 2.0


def test_zero_previous_amount(spark):
    r = by_id(sequence.account_history(tx(spark, [(1, "a", 0, 0), (2, "a", 60, 5)])))[2]
    assert r["amount_ratio"] is None and r["amount_deviation_from_avg"] is None
    assert r["time_since_prev_tx"] == 1.0


def test_only_five_rows_back(spark):
    r = by_id(sequence.account_history(tx(spark, [(i, "a", i * 60, 10**i) for i in range(8)])))[7]
    assert r["tx_count_last5"] == 5 and r["max_amount_last5"] == 10**6
    assert r["avg_amount_last5"] == pytest.approx(sum(10**i for i in range(2, 7)) / 5)


def test_bins_of_missing_scores(spark):
    row = spark.createDataFrame([(None,)], "s double").select(
        scalar.geo_anomaly_bin(F.col("s")).alias("g"), scalar.spending_risk(F.col("s")).alias("r")
    ).first()
    assert (row["g"], row["r"]) == ("high", "low")


def test_amount_log_outside_its_domain(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "a double").select(scalar.amount_log(F.col("a")).alias("l"))
    assert [r[0] for r in df.collect()] == [None, None, 0.0]


def test_velocity_edges(spark):
    day = 86_400
    df = tx(spark, [(1, "a", 0, 1), (2, "a", day, 2)])
    exact = by_id(velocity.velocity_features(df, "sender_account", "timestamp", "transaction_id", "amount", [1]))[2]
    assert exact["sender_account_txn_count_1d"] == 1 and exact["sender_account_amount_sum_1d"] == 1.0
    rolled = by_id(velocity.rolling_time_aggs(df, "sender_account", "amount", "timestamp", [1]))[2]
    assert rolled["sender_account_amount_1d_count"] == 1
    first = by_id(velocity.velocity_features(df, "sender_account", "timestamp", "transaction_id", "amount", [1]))[1]
    assert first["sender_account_amount_sum_1d"] == 0.0 and first["sender_account_amount_mean_1d"] is None


@pytest.mark.parametrize("micros,inside", [(-1, True), (0, True), (1, False)])
def test_velocity_one_microsecond(spark, micros, inside, settings):
    rows = [(1, "a", T0, 1.0), (2, "a", T0 + dt.timedelta(days=1, microseconds=micros), 2.0)]
    df = spark.createDataFrame(rows, "transaction_id long, sender_account string, timestamp timestamp, amount double")
    for limit in (10, 1):
        settings(velocity.RANGE_FRAME_ROWS_CONF, limit)
        out = by_id(velocity.velocity_features(df, "sender_account", "timestamp", "transaction_id", None, [1]))
        assert out[2]["sender_account_txn_count_1d"] == int(inside)


def test_weekdays_count_both_ways(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 5),)], "t timestamp")  # a Sunday
    row = df.select(
        scalar.calendar_parts(F.col("t"))["day_of_week"].alias("a"), scalar.time_features(F.col("t"), "t")["t_dayofweek"].alias("b"),
        scalar.time_features(F.col("t"), "t")["t_is_weekend"].alias("w"), scalar.time_features(F.col("t"), "t")["t_time_of_day"].alias("d"),
    ).first()
    assert (row["a"], row["b"], row["w"], row["d"]) == (1, 6, 1, "night")


def test_short_pi_is_the_default(spark):
    df = spark.createDataFrame([(6, 1, 1)], "h int, d int, m int")
    cols = scalar.cyclical_time(F.col("h"), F.col("d"), F.col("m"))
    assert df.select(cols["hour_sin"]).first()[0] == pytest.approx(math.sin(2 * 3.14159 * 6 / 24), abs=1e-12)


def test_amount_bins_merge_duplicate_edges(spark):
    df = spark.createDataFrame([(0.0,)] * 90 + [(float(i),) for i in range(1, 11)], "v double")
    bins = {r["v"]: r["v_bin"] for r in amount_features(df, "v").collect()}
    assert bins[0.0] == 0 and bins[10.0] == max(bins.values()) == 1 - 1 + len(set(bins.values())) - 1


def test_impute_eval_defaults_by_name(spark):
    df = spark.createDataFrame(
        [(4.0, None, None, None, 1.0), (6.0, None, None, None, None)],
        "amount double, amount_ratio double, max_amount double, other double, seen double",
    )
    rows = clean.impute_eval(df, ["amount_ratio", "max_amount", "other", "seen"]).orderBy("amount").collect()
    assert [r["amount_ratio"] for r in rows] == [0.0, 0.0]
    assert [r["max_amount"] for r in rows] == [4.0, 6.0]
    assert [r["other"] for r in rows] == [0.0, 0.0] and rows[1]["seen"] == 1.0


def test_strict_alignment_refuses_missing_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert align.align_features_strict(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(align.MissingFeatures):
        align.align_features_strict(df, ["a", "c"])


def test_labels_are_never_features(spark):
    df = spark.createDataFrame([(1, 1.0, 0)], "fraud_label int, amount double, hour int").withColumn("is_fraud", F.lit(1))
    assert clean.feature_names(df.schema) == ["amount", "hour"]


def test_pad_trims_and_fills(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(vectors.pad(F.col("x"), 5)).first()[0] == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert df.select(vectors.pad(F.col("x"), 2)).first()[0] == [1.0, 2.0]


def test_pipeline_works_without_optional_columns(spark):
    out = pipeline.engineer_features(tx(spark, [(1, "a", 0, 5), (2, "a", 9, None), (3, None, 9, 1)]))
    assert out.count() == 1 and "spending_risk" not in out.columns and "amount_log" in out.columns
