"""Per-account history on a stream: the last five rows of every account are its state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txrisk.functions.scalar import micros
from txrisk.operators.sequence import REACH, features_of_recent

#: Keyed state needs this store; set it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_KEPT = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("id", T.ArrayType(T.StringType())), T.StructField("v", T.ArrayType(T.DoubleType()))])


#: Rows of a batch that one state partition takes, about.
STATE_PARTITION_ROWS = 200_000


def state_partitions(rows: int, least: int = 4) -> int:
    """How many partitions the state needs for batches of so many rows; a stream keeps the number it began with."""
    return max(least, math.ceil(rows / STATE_PARTITION_ROWS))


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


class LastRows(StatefulProcessor):
    """Hands every row the rows before it in time, and keeps the account's last ones.

    Rows of a batch are taken by time, then id. A late row, older than one already kept, sees the kept rows that are
    older than it and takes its place among them if it is one of the last; rows already given out are not revised.
    An account that is silent for longer than the time limit starts anew.
    """

    def __init__(self, limit_ms: int | None) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", _KEPT, self.limit_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        new = frames[0] if len(frames) == 1 else pd.concat(frames)
        # The state is asked once: None is an account without any.
        before = self.state.get()
        kept = list(zip(*map(list, before))) if before else []
        kept = [(int(us), str(row), _number(v)) for us, row, v in kept]
        mine = sorted(zip(map(int, new["us"]), map(str, new["row"]), map(_number, new["v"])), key=lambda k: k[:2])
        line = [*kept, *mine]
        if all(a[:2] < b[:2] for a, b in zip(line, line[1:])):
            # No row is late: a row's history are the rows in front of it.
            past = [line[max(0, i - REACH) : i] for i in range(len(kept), len(line))]
            kept = line[-REACH:]
        else:
            past = []
            for row in mine:
                past.append([k for k in kept if k[:2] < row[:2]])
                kept = sorted([*kept, row], key=lambda k: k[:2])[-REACH:]
        self.state.update(tuple(map(list, zip(*kept))))
        us, ids, values = zip(*mine)
        seconds = [[k[0] // 1_000_000 for k in p] for p in past]
        yield pd.DataFrame(
            {"account": [new["account"].iloc[0]] * len(mine), "us": us, "row": ids, "v": pd.Series(values, dtype="float64"), "s": seconds, "w": [[k[2] for k in p] for p in past]}
        )

    def close(self) -> None:
        pass


def stream_history_features(
    stream: DataFrame, account: str = "sender_account", time: str = "timestamp", amount: str = "amount", row_id: str = "transaction_id",
    limit_ms: int | None = None,
) -> DataFrame:
    """``account_history`` for a stream (or a table): the row's id, account, time and amount, and its features.

    Over rows that come in the order of their time the features are those of ``account_history``; ids decide between
    rows of one moment, as texts. Rows without an account, a time or an id are left out. ``limit_ms`` is how long an
    account's rows are kept without a new one.
    """
    kind = stream.schema[account].dataType.simpleString()
    slim = stream.select(
        F.col(account).alias("account"), micros(F.col(time)).alias("us"), F.col(row_id).cast("string").alias("row"), F.col(amount).cast("double").alias("v")
    ).filter("account is not null and us is not null and row is not null")
    out = slim.groupBy("account").transformWithStateInPandas(
        statefulProcessor=LastRows(limit_ms),
        outputStructType=f"account {kind}, us long, row string, v double, s array<long>, w array<double>",
        outputMode="Append",
        timeMode="ProcessingTime" if limit_ms else "None",
    )
    named = out.select(
        F.col("row").alias(row_id), F.col("account").alias(account), F.timestamp_micros("us").alias(time), F.col("v").alias(amount),
        F.arrays_zip(F.col("s"), F.col("w").alias("v")).alias("recent"),
    )
    return features_of_recent(named, "recent", time, amount).drop("recent")
