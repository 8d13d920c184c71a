"""Per-account history features.

All of them look at most five rows back, so one window spec serves every column: one
exchange and one sort on the account. Rows are ordered by time and then by row id, which
makes ties reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txrisk.functions.scalar import micros, ratio, whole_seconds
from txrisk.operators.ordering import group_rank, largest_group, row_frames, stored
from txrisk.session import max_group_rows

REACH = 5
_BASE = ("_prev_s", "_prev", "_avg", "_max", "_cnt", "_old_s")

# The features of account_history, in output order.
HISTORY_COLUMNS = (
    "time_since_prev_tx",
    "amount_delta",
    "amount_ratio",
    "avg_amount_last5",
    "max_amount_last5",
    "tx_count_last5",
    "time_span_days",
    "transaction_frequency",
    "amount_deviation_from_avg",
    "tx_velocity",
)


def _windows(w: WindowSpec, time: str, amount: str) -> dict[str, Column]:
    """What has to be read from neighbouring rows; each appears once in the Window node."""
    recent = w.rowsBetween(-REACH, -1)
    seconds, value = whole_seconds(F.col(time)), F.col(amount)
    return {
        "_prev_s": F.lag(seconds, 1).over(w),
        "_prev": F.lag(value, 1).over(w),
        "_avg": F.avg(value).over(recent),
        "_max": F.max(value).over(recent),
        "_cnt": F.count(value).over(recent),
        "_old_s": F.min(seconds).over(recent),
    }


def _features(time: str, amount: str) -> dict[str, Column]:
    seconds, value, mean, count = whole_seconds(F.col(time)), F.col(amount), F.col("_avg"), F.col("_cnt")
    span = F.when(F.col("_old_s").isNotNull(), (seconds - F.col("_old_s")) / 86400.0).otherwise(1.0)
    return {
        # Minutes, from whole seconds.
        "time_since_prev_tx": (seconds - F.col("_prev_s")) / 60.0,
        "amount_delta": value - F.col("_prev"),
        "amount_ratio": F.when(F.col("_prev") > 0, ratio(value, F.col("_prev"))),
        "avg_amount_last5": mean,
        "max_amount_last5": F.col("_max"),
        "tx_count_last5": count,
        "time_span_days": span,
        "transaction_frequency": F.when(span > 0, ratio(count, span)).otherwise(count.cast("double")),
        "amount_deviation_from_avg": F.when(mean.isNotNull(), ratio(value - mean, mean)).otherwise(0.0),
        "tx_velocity": count / float(REACH),
    }


def features_of_recent(df: DataFrame, recent: str, time: str, amount: str) -> DataFrame:
    """The history features from an array of the (at most five) rows before, oldest first, with fields s and v."""
    values = F.transform(F.filter(recent, lambda r: r["v"].isNotNull()), lambda r: r["v"])
    last = F.try_element_at(recent, F.lit(-1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    count = F.size(values).cast("long")
    base = {
        "_prev_s": last["s"],
        "_prev": last["v"],
        "_avg": F.when(count > 0, total / F.greatest(count, F.lit(1))),
        "_max": F.array_max(values),
        "_cnt": count,
        "_old_s": F.array_min(F.transform(recent, lambda r: r["s"])),
    }
    return df.withColumns(base).withColumns(_features(time, amount)).drop(*_BASE)


def account_history(
    df: DataFrame,
    columns: Sequence[str] = HISTORY_COLUMNS,
    account: str = "sender_account",
    time: str = "timestamp",
    amount: str = "amount",
    row_id: str = "transaction_id",
) -> DataFrame:
    """Add the chosen history features; the current row never counts as its own history."""

    ordered = df.withColumn("_us", micros(F.col(time)))
    framed = row_frames(ordered, [account], ["_us", row_id], REACH, lambda w: _windows(w, time, amount))
    every = _features(time, amount)
    return framed.withColumns({c: every[c] for c in columns}).drop("_us", *_BASE)


def entity_time_diff(df: DataFrame, entity: str, time: str, row_id: str, rows: int | None = None) -> DataFrame:
    """Hours since the entity's previous row. ``rows``: known bound of the rows of one entity."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"{entity}_time_diff": (F.col("_at") - F.lag("_at", 1).over(w)) / 3.6e9}

    ordered = df.withColumn("_at", micros(F.col(time)))
    return row_frames(ordered, [entity], ["_at", row_id], 1, build, rows=rows).drop("_at")


def history_features(
    df: DataFrame,
    account: str = "sender_account",
    time: str = "timestamp",
    amount: str = "amount",
    row_id: str = "transaction_id",
) -> DataFrame:
    """The simulator's history: whole-history span and pace, with its own no-history defaults."""
    # The number of earlier rows is a prefix count; in a split group it needs the totals of
    # the earlier chunks, so it comes from the ranking primitive, not from a row frame.
    ordered = df.withColumn("_us", micros(F.col(time)))
    most = largest_group(ordered, [account])
    if most > max_group_rows(df.sparkSession):
        ordered, _ = stored(ordered)
    ranked = group_rank(ordered, [account], ["_us", row_id], "_rank", rows=most)

    def build(w: WindowSpec) -> dict[str, Column]:
        recent = w.rowsBetween(-REACH, -1)
        return {
            "_prev_s": F.lag("_us", 1).over(w),
            "_prev": F.lag(amount, 1).over(w),
            "_avg": F.avg(amount).over(recent),
            "_max": F.max(amount).over(recent),
            "_cnt": F.count(amount).over(recent),
            "_old_s": F.first("_us").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }

    value, seen, previous, mean = F.col(amount), F.col("_rank") - 1, F.col("_prev"), F.col("_avg")
    days = F.when(seen > 1, (F.col("_us") - F.col("_old_s")) / 8.64e10).otherwise(0.0)
    features = {
        "hours_since_prev": F.coalesce((F.col("_us") - F.col("_prev_s")) / 3.6e9, F.lit(24.0)),
        "hist_delta": F.coalesce(value - previous, F.lit(0.0)),
        "hist_ratio": F.when(previous.isNotNull(), value / F.greatest(F.lit(1.0), previous)).otherwise(1.0),
        "hist_avg_last5": F.coalesce(mean, value),
        "hist_max_last5": F.coalesce(F.col("_max"), value),
        "hist_count_last5": F.col("_cnt"),
        "hist_span_days": days,
        "hist_frequency": F.when(seen > 1, seen / F.greatest(F.lit(1.0), days)).otherwise(0.0),
        "hist_deviation": F.coalesce(value - mean, F.lit(0.0)),
        "hist_velocity": F.when(days > 0, ratio(seen, days * 24)).otherwise(0.0),
    }
    framed = row_frames(ranked, [account], ["_us", row_id], REACH, build, keep_first=True, rows=most)
    return framed.withColumns(features).drop("_us", "_rank", *_BASE)


def sort_entity_time(df: DataFrame, entity: str, time: str, row_id: str) -> DataFrame:
    """Global order by entity and time: a range-partitioned sort."""
    return df.orderBy(entity, time, row_id)
