"""Row-wise feature expressions. Every function takes columns and returns columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the truncated pi the batch features are defined with.
SHORT_PI = 3.14159
MICROS_PER_DAY = 86_400_000_000


def null_if_nan(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of an error on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def amount_log(amount: Column) -> Column:
    """ln(amount + 1), NULL where it is undefined."""
    return F.when(amount > -1, F.log1p(amount))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def whole_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def calendar_parts(ts: Column) -> dict[str, Column]:
    """hour, day of week (Sunday = 1), month, year."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "month": F.month(ts),
        "year": F.year(ts),
    }


def cyclical(value: Column, period: float, pi: float = math.pi) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * pi / period)
    return F.sin(angle), F.cos(angle)


def cyclical_time(hour: Column, day: Column, month: Column, day_period: int = 7, pi: float = SHORT_PI) -> dict[str, Column]:
    """sin/cos of hour, day and month. ``day_period=31, pi=math.pi`` fits day-of-month input."""
    out: dict[str, Column] = {}
    for name, value, period in (("hour", hour, 24), ("day", day, day_period), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(value, period, pi)
    return out


def velocity_score_norm(score: Column, scale: float = 100.0) -> Column:
    return score / F.lit(float(scale))


def geo_anomaly_bin(score: Column) -> Column:
    """Below 0.3 low, below 0.7 medium, everything else (NULL too) high."""
    return F.when(score < 0.3, "low").when(score < 0.7, "medium").otherwise("high")


def spending_risk(score: Column) -> Column:
    """Above 1.5 high, above 0.5 medium, everything else (NULL too) low."""
    return F.when(score > 1.5, "high").when(score > 0.5, "medium").otherwise("low")


def device_channel(device: Column, channel: Column) -> Column:
    return F.concat(device, F.lit("_"), channel)


def time_features(ts: Column, prefix: str) -> dict[str, Column]:
    """Calendar features with Monday = 0, a weekend flag and six-hour bands."""
    weekday, hour = F.weekday(ts), F.hour(ts)
    band = F.element_at(F.array(*[F.lit(b) for b in ("night", "morning", "afternoon", "evening")]), F.floor(hour / 6).cast("int") + 1)
    return {
        f"{prefix}_hour": hour,
        f"{prefix}_day": F.dayofmonth(ts),
        f"{prefix}_dayofweek": weekday,
        f"{prefix}_month": F.month(ts),
        f"{prefix}_year": F.year(ts),
        f"{prefix}_quarter": F.quarter(ts),
        f"{prefix}_is_weekend": (weekday >= 5).cast("int"),
        f"{prefix}_time_of_day": band,
    }


def default_tx_frequency(seconds_since_last: Column | None) -> Column:
    """Transactions per day from the gap in seconds; 1.0 without a usable gap."""
    if seconds_since_last is None:
        return F.lit(1.0)
    return F.when(seconds_since_last > 0, ratio(F.lit(86400.0), seconds_since_last)).otherwise(1.0)


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many of the sorted ``edges`` are <= value."""
    return F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e <= value))
