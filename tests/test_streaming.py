"""The stream scores like a batch, survives bad input and replays."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from txrisk.datasets import transactions
from txrisk.operators import sequence
from txrisk.operators.scoring_set import Linear, ScoringSet
from txrisk.plans import queries_models  # noqa: F401  (register)
from txrisk.plans.registry import QUERIES, rounded
from txrisk.session import settings
from txrisk.streaming import history, scoring, sources


def scorer(batch):
    return batch.withColumn("fraud_probability", F.col("amount") / (F.col("amount") + 50.0))


@pytest.fixture
def folder(tmp_path):
    def record(i, **extra):
        return {"transaction_id": f"t{i}", "timestamp": "2024-01-01T00:00:00.000Z", "amount": 10.0 * i, "sender_account": "a", "receiver_account": "b", "merchant_category": "m", **extra}

    path = tmp_path / "in"
    path.mkdir()
    for f in range(3):
        lines = [json.dumps(record(f * 5 + i)) for i in range(5)]
        (path / f"{f}.json").write_text("\n".join(lines) + "\n")
    return str(path)


def run(spark, folder, out, checkpoint):
    stream = sources.stream_files(spark, folder)
    job = scoring.score_stream(stream, scorer, scoring.sink_files(out), checkpoint=checkpoint, once=True)
    job.awaitTermination()
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, folder, tmp_path):
    got = run(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = scoring.score_batch(spark.read.schema(sources.STREAM_RECORD).json(folder), scorer, 0)
    columns = ["transaction_id", "fraud_probability", "is_fraud_classification", "is_fraud_ensemble", "amount"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert got.select("epoch").distinct().count() == 3  # one file per trigger


def test_checkpoint_prevents_double_output(spark, folder, tmp_path):
    args = (spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run(*args).count() == run(*args).count() == 15


def test_replayed_epoch_overwrites(spark, folder, tmp_path):
    sink = scoring.sink_files(str(tmp_path / "out"))
    batch = scoring.score_batch(spark.read.schema(sources.STREAM_RECORD).json(folder), scorer, 4)
    sink(batch, 4)
    sink(batch, 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_malformed_and_partial_lines(spark):
    lines = spark.createDataFrame(
        [('{"transaction_id":"t1","amount":5.0}',), ("{broken",), ('{"transaction_id":"t2"}',)], "value string"
    )
    good, bad = sources.split_rejects(sources.parse_json(lines))
    assert good.count() == 2 and bad.count() == 1
    assert good.filter("transaction_id = 't2'").first()["amount"] is None


def test_kafka_payload_has_key_and_value(spark):
    df = spark.createDataFrame([(1, 2.0)], "transaction_id long, amount double")
    row = scoring.kafka_payload(df).first()
    assert row["key"] == "1" and json.loads(row["value"]) == {"transaction_id": 1, "amount": 2.0}


def test_connector_options():
    assert sources.kafka_options("h:1") == {"kafka.bootstrap.servers": "h:1", "subscribe": "transactions", "startingOffsets": "latest"}
    assert sources.socket_options(port=7) == {"host": "localhost", "port": "7"}
    assert scoring.trigger_options() == {"processingTime": "1 seconds"}
    assert scoring.trigger_options(once=True) == {"availableNow": True}


def test_console_sink_runs(spark, folder):
    scoring.sink_console(2)(spark.read.schema(sources.STREAM_RECORD).json(folder), 0)


def test_kafka_needs_its_connector(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sources.stream_kafka(spark, "localhost:9092")


def test_rows_without_id_are_named_alike_on_replay(spark):
    rows = spark.createDataFrame([(None, float(i)) for i in range(20)], "transaction_id string, amount double")
    one = scoring.score_batch(rows.repartition(3), scorer, 2).select("amount", "transaction_id").collect()
    two = scoring.score_batch(rows.repartition(5), scorer, 2).select("amount", "transaction_id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len({r[1] for r in one}) == 20


def test_saved_set_survives_a_restart(spark, folder, tmp_path):
    saved = ScoringSet(("amount", "amount_log", "unknown"), (0.0, 0.0, 0.0), (50.0, 3.0, 0.0), (20.0, 1.0, 1.0), Linear((1.0, -0.5, 9.0), 0.1))
    saved.save(spark, str(tmp_path / "set"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run_once():
        scoring.score_stream_with(sources.stream_files(spark, folder), str(tmp_path / "set"), scoring.sink_files(out), cp, once=True).awaitTermination()

    run_once()
    (tmp_path / "in" / "9.json").write_text(json.dumps({"transaction_id": "t99", "amount": 7.0}) + "\n")
    run_once()
    got = {r["transaction_id"]: r["fraud_probability"] for r in spark.read.parquet(out).collect()}
    batch = saved.score(spark.read.schema(sources.STREAM_RECORD).json(folder)).collect()
    assert got == {r["transaction_id"]: r["fraud_probability"] for r in batch} and len(got) == 16


def run_history(spark, batches, tmp_path):
    """The rows that come out after each batch of records, in arrival order."""
    source, out, cp = (str(tmp_path / n) for n in ("src", "hist", "cp"))
    os.makedirs(source)
    got, seen = [], 0
    for i, rows in enumerate(batches):
        with open(f"{source}/{i}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("transaction_id", "timestamp", "sender_account", "amount"), r))) + "\n" for r in rows)
        with settings(spark, history.STATE_STORE | {"spark.sql.shuffle.partitions": 2}):
            made = history.stream_history_features(sources.stream_files(spark, source))
            job = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            job.awaitTermination()
        now = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
        got.append({k: v for k, v in now.items() if k not in seen} if seen else now)
        seen = set(now)
    return got


def at(minute):
    return f"2024-01-01T00:{minute:02d}:00.000Z"


def test_history_on_a_stream(spark, tmp_path):
    first = [("t1", at(1), "a", 10.0), ("t3", at(3), "a", None), ("t0", at(0), "b", 5.0), ("x", at(1), None, 1.0), (None, at(1), "a", 1.0), ("y", None, "a", 1.0)]
    second = [(f"t{m}", at(m), "a", float(m)) for m in (9, 5, 6, 7, 8)]
    late = [("t4", at(4), "a", 100.0), ("t2", at(2), "a", 7.0), ("u10", at(10), "a", 1.0)]
    one, two, three = run_history(spark, [first, second, late], tmp_path)
    assert set(one) == {"t1", "t3", "t0"}
    assert one["t3"]["time_since_prev_tx"] == 2.0 and one["t3"]["tx_count_last5"] == 1 and one["t1"]["time_span_days"] == 1.0
    # In time order whatever the order in the file: t5 follows t3 and t1.
    assert two["t5"]["avg_amount_last5"] == 10.0 and two["t9"]["avg_amount_last5"] == pytest.approx((5 + 6 + 7 + 8) / 4)
    # Kept are t5 to t9: t2 and t4 come too late to see anything, and don't push a kept row out.
    assert three["t4"]["tx_count_last5"] == 0 and three["t2"]["time_since_prev_tx"] is None
    assert three["u10"]["avg_amount_last5"] == 7.0 and three["u10"]["max_amount_last5"] == 9.0


def test_history_with_a_time_limit_builds(spark, folder):
    made = history.stream_history_features(sources.stream_files(spark, folder), limit_ms=60_000)
    assert made.isStreaming and "tx_velocity" in made.columns


def test_state_partitions_follow_the_rows():
    assert history.state_partitions(0) == history.state_partitions(800_000) == 4
    assert history.state_partitions(36_000_000) == 180


def test_a_batch_of_very_many_files_keeps_the_order_of_time(spark, tmp_path):
    """More files than one trigger used to take, each with rows of all times."""
    i = F.col("id")
    events = spark.range(0, 440, 1, 110).select(
        i.alias("event_id"), F.timestamp_seconds(1_700_000_000 + (i % 4) * 110 * 60 + F.floor(i / 4) * 60).cast("timestamp_ntz").alias("ts"),
        (i % 2).alias("user_id"), F.lit("view").alias("event_type"), (i % 97).cast("double").alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    with settings(spark, {"spark.sql.files.openCostInBytes": 2**27}):
        streamed = QUERIES["stream_history_features"].run(spark, str(tmp_path))
        batch = rounded(sequence.account_history(transactions(spark, str(tmp_path))).select(*streamed.columns), *sequence.HISTORY_COLUMNS)
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
