"""Group statistics, their join back onto the rows, and set operations on samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.ordering import exact_quantiles, fetch_quantiles
from txrisk.session import max_broadcast_bytes


def group_stats(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """mean, std (sample), min, max, count of each value column per group."""
    aggs = []
    for v in values:
        stem = f"{group}_{v}"
        aggs += [
            F.avg(v).alias(f"{stem}_mean"),
            F.stddev_samp(v).alias(f"{stem}_std"),
            F.min(v).alias(f"{stem}_min"),
            F.max(v).alias(f"{stem}_max"),
            F.count(v).alias(f"{stem}_count"),
        ]
    return df.groupBy(group).agg(*aggs)


def _broadcast_if_small(stats: DataFrame, groups: int) -> DataFrame:
    """Hint a broadcast when ``groups`` rows of this width fit the configured size."""
    width = 16 * len(stats.columns) + 32
    return F.broadcast(stats) if groups * width <= max_broadcast_bytes(stats.sparkSession) else stats


def join_group_stats(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row with the statistics of its groups; a NULL group gets NULLs.

    The distinct groups are estimated in one pass (with a margin above the sketch's error). Few
    groups are broadcast, so the rows stay where they are; many are sort-merged, where the
    adaptive planner splits the rows of a skewed group.
    """
    sizes = df.agg(*[F.approx_count_distinct(g, 0.02).alias(g) for g in groups]).first()

    def add(out: DataFrame, g: str) -> DataFrame:
        return out.join(_broadcast_if_small(group_stats(df, g, values), int(sizes[g] * 1.5) + 1), g, "left")

    return reduce(add, groups, df)


def amount_features(df: DataFrame, amount: str, bins: int = 10) -> DataFrame:
    """log1p of the non-negative amount and its quantile bin (right-closed, duplicate edges merged)."""
    clipped = F.greatest(F.col(amount), F.lit(0.0))
    edges = fetch_quantiles(
        df.select(clipped.alias("_a")), "_a", [i / bins for i in range(1, bins)]
    )
    low = df.agg(F.min(clipped)).first()[0]
    # An inner edge equal to the minimum closes an empty first bin, so it is a duplicate too.
    inner = sorted({e for e in edges or [] if low is None or e > low})
    position = F.size(F.filter(F.lit(inner) if inner else F.array().cast("array<double>"), lambda e: e < clipped))
    return df.withColumns(
        {f"{amount}_log": F.log1p(clipped), f"{amount}_bin": F.when(F.col(amount).isNotNull(), position)}
    )


def union_samples(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def remaining_rows(df: DataFrame, sampled: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not in the sample."""
    return df.join(sampled.select(row_id), row_id, "left_anti")


def quantile_table(df: DataFrame, value: str, probs: Sequence[float], key: str) -> DataFrame:
    """(key, prob, value) in long form."""
    table = exact_quantiles(df, value, probs, [key])
    return table.select(key, F.posexplode("quantiles").alias("pos", "value")).withColumn(
        "prob", F.element_at(F.lit([float(p) for p in probs]), F.col("pos") + 1)
    ).drop("pos")
