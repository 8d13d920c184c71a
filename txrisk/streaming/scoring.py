"""Scoring of a stream, micro-batch by micro-batch.

The batch function stays lazy and on the executors: it scores with the same DataFrame operators
as a batch job and writes the result itself. ``foreachBatch`` may replay a batch after a failure,
so file output goes to a folder per epoch that a replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators.scoring import apply_threshold, ensemble_or, score_output
from txrisk.operators.scoring_set import ScoringSet
from txrisk.session import scratch_path

Scorer = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]


def score_batch(batch: DataFrame, scorer: Scorer, epoch: int, probability_cut: float = 0.5, anomaly_cut: float | None = None) -> DataFrame:
    """Scores, flags and output layout of one micro-batch (or of any table)."""
    flagged = apply_threshold(scorer(batch), probability_cut=probability_cut, anomaly_cut=anomaly_cut)
    return score_output(ensemble_or(flagged), epoch=epoch).withColumn("epoch", F.lit(epoch).cast("long"))


def sink_files(path: str, fmt: str = "parquet") -> Sink:
    """One folder per epoch, overwritten on replay."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.drop("epoch").write.mode("overwrite").format(fmt).save(f"{path}/epoch={epoch}")

    return write


def sink_console(rows: int = 20) -> Sink:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.show(rows, truncate=False)

    return write


def kafka_payload(batch: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The key/value columns a Kafka sink needs."""
    return batch.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*batch.columns)).alias("value"))


def sink_kafka(servers: str, topic: str) -> Sink:
    """Needs the Kafka connector; consumers drop replays by (transaction_id, epoch)."""

    def write(batch: DataFrame, epoch: int) -> None:
        kafka_payload(batch).write.format("kafka").options(
            **{"kafka.bootstrap.servers": servers, "topic": topic}
        ).save()

    return write


def trigger_options(once: bool = False, seconds: int = 1) -> dict:
    """One-second micro-batches in operation, drain-and-stop for back-fills and tests."""
    return {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}


def score_stream(
    stream: DataFrame,
    scorer: Scorer,
    sink: Sink,
    checkpoint: str | None = None,
    once: bool = False,
    seconds: int = 1,
    probability_cut: float = 0.5,
    anomaly_cut: float | None = None,
) -> StreamingQuery:
    """Start the job; empty batches are skipped."""

    def handle(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(score_batch(batch, scorer, epoch, probability_cut, anomaly_cut), epoch)

    place = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", place)
        .foreachBatch(handle)
        .trigger(**trigger_options(once, seconds))
        .start()
    )


def score_stream_with(
    stream: DataFrame, set_path: str, sink: Sink, checkpoint: str | None = None, once: bool = False, seconds: int = 1
) -> StreamingQuery:
    """Start the job with a saved set: read once when the stream starts, applied to every batch on the executors.

    Nothing of the job's state is in this process but the set, so a restart from the checkpoint scores alike.
    """
    saved = ScoringSet.load(stream.sparkSession, set_path)
    return score_stream(
        stream, saved.score, sink, checkpoint, once, seconds, probability_cut=saved.probability_cut, anomaly_cut=saved.anomaly_cut
    )
