"""Distribution drift, performance change and what to do about it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import null_if_nan, ratio
from txrisk.operators.clean import unpivot_numeric
from txrisk.operators.evaluation import binary_metrics
from txrisk.operators.ordering import prefix_sums, stored
from txrisk.schema import numeric_columns

# Limits of the monitoring rules.
P_VALUE_LIMIT = 0.05
HIGH_DRIFT_PCT = 50.0
MODERATE_DRIFT_PCT = 20.0
ACCURACY_SHIFT = 0.1
KS_TERMS = 100
KS_SMALL = 0.2


def ks_p_value(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p of the Kolmogorov-Smirnov statistic.

    Below lambda = 0.2 the series converges too slowly and the value is 1 to twelve digits.
    """
    lam = statistic * F.sqrt(ratio(n1.cast("double") * n2, n1 + n2))

    def term(acc: Column, j: Column) -> Column:
        sign = F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return acc + sign * F.exp(F.lit(-2.0) * j * j * lam * lam)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), term)
    return F.when(lam < KS_SMALL, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def exact_ks_p(statistic: float, n1: int, n2: int) -> float:
    """Chance that the two samples' distribution functions differ by at least the statistic somewhere.

    All orders of the pooled values are equally likely, so the pair of counts seen so far is a path through a
    lattice; the path's chance to leave the band |i/n1 - j/n2| < statistic is added up step by step, each step one
    vector operation. Nothing is subtracted from 1, so small values keep their digits.
    """
    m, n = int(n1), int(n2)
    g = math.gcd(m, n)
    height = round(statistic * (m // g) * n)
    if height == 0:
        return 1.0
    chance, left = np.zeros(m + 1), 0.0
    chance[0] = 1.0
    at = np.arange(m + 1)
    for step in range(m + n):
        rest = m + n - step
        seen = step - at
        up = chance * np.clip(n - seen, 0, None) / rest
        up[1:] += chance[:-1] * (m - at[:-1]) / rest
        seen = step + 1 - at
        outside = np.abs(at * (n // g) - seen * (m // g)) >= height
        inside_lattice = (seen >= 0) & (seen <= n)
        left += float(up[outside & inside_lattice].sum())
        chance = np.where(outside | ~inside_lattice, 0.0, up)
    return min(left, 1.0)


@F.pandas_udf(T.DoubleType())
def _exact_p(statistic: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or math.isnan(d) or not a or not b else exact_ks_p(d, a, b) for d, a, b in zip(statistic, n1, n2)], dtype="float64")


#: Larger samples than this (the larger one counts) get the asymptotic p.
EXACT_ROWS = 10_000


def ks_drift(
    reference: DataFrame, production: DataFrame, features: Sequence[str], limit: float = P_VALUE_LIMIT, method: str = "auto"
) -> DataFrame:
    """KS statistic, p-value and verdict per numeric feature both tables have.

    ``method``: "exact", "asymptotic", or "auto", exact while both samples have at most ``EXACT_ROWS`` values.

    All features share one pass: counts per (feature, value), then prefix sums per feature.
    """
    tested = [f for f in features if f in numeric_columns(reference.schema) and f in numeric_columns(production.schema)]
    if not tested:
        return reference.sparkSession.createDataFrame(
            [], "feature string, ks_statistic double, p_value double, drift_detected boolean"
        )
    both = (
        unpivot_numeric(reference, tested)
        .withColumn("_new", F.lit(False))
        .unionByName(unpivot_numeric(production, tested).withColumn("_new", F.lit(True)))
        .filter(F.col("value").isNotNull())
    )
    counted, rows = stored(
        both.groupBy("feature", "value").agg(F.count_if(~F.col("_new")).alias("n_ref"), F.count_if(F.col("_new")).alias("n_prod"))
    )
    sums = {"ref": F.col("n_ref"), "prod": F.col("n_prod")}
    ranked = prefix_sums(counted, ["feature"], ["value"], sums, totals=True, rows=rows, kept=True)
    gap = F.abs(ratio(F.col("ref"), F.col("ref_total")) - ratio(F.col("prod"), F.col("prod_total")))
    stats = ranked.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("ref_total").alias("_n1"), F.max("prod_total").alias("_n2")
    )
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method: {method}")
    p = ks_p_value(F.col("ks_statistic"), F.col("_n1"), F.col("_n2"))
    if method != "asymptotic":
        # One short row per feature goes through Python.
        exact = F.greatest("_n1", "_n2") <= F.lit(EXACT_ROWS if method == "auto" else 2**62)
        small = stats.withColumn("_exact", _exact_p(F.when(exact, F.col("ks_statistic")), F.col("_n1"), F.col("_n2")))
        stats, p = small, F.coalesce("_exact", p)
    return stats.select("feature", "ks_statistic", p.alias("p_value")).withColumn(
        "drift_detected", F.col("p_value") < limit
    )


def drift_summary(drift: DataFrame, limit: float = P_VALUE_LIMIT) -> DataFrame:
    """One row: tested and drifted features, their share and their sorted names."""
    hit = F.col("drift_detected")
    return drift.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(hit).alias("drifted"),
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("drift_share"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(hit, F.col("feature"))))).alias("drifted_features"),
    ).withColumn("drift_threshold", F.lit(limit))


def drift_histograms(
    reference: DataFrame, production: DataFrame, drift: DataFrame, bins: int = 50, k: int = 10
) -> DataFrame:
    """Reference and production histograms of the first ``k`` drifted features (by name)."""
    names = [r[0] for r in drift.filter("drift_detected").orderBy("feature").limit(k).select("feature").collect()]
    if not names:
        return reference.sparkSession.createDataFrame([], "source string, bucket int, n bigint, lower double, feature string")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), null_if_nan(F.col(c)).alias("v")) for c in names])
    long = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(source).alias("source"), F.inline(values)) for source, df in (("reference", reference), ("production", production))],
    ).filter(F.col("v").isNotNull())
    # One pass for the spans, one for the counts, whatever the number of features; at most k spans.
    spans = long.groupBy(F.col("feature").alias("_f")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = long.join(F.broadcast(spans), F.col("feature") == F.col("_f"))
    place = F.coalesce(ratio((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))
    bucket = F.least(F.floor(place).cast("int"), F.lit(bins - 1))
    counts = placed.groupBy("source", "feature", "lo", "hi", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    lower = F.col("lo") + F.col("bucket") * (F.col("hi") - F.col("lo")) / bins
    return counts.select("source", "bucket", "n", lower.alias("lower"), "feature")


def monitor_performance(df: DataFrame, source: str, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Metrics of both sources, their difference, and whether production flags anything at all.

    ``source`` holds ``reference`` or ``production``.
    """
    flagged = df.withColumn("_guess", (F.col(score) >= cut).cast("int"))
    long = binary_metrics(flagged, label, "_guess", [source])
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col(source) == "reference", F.col("value"))).alias("reference"),
        F.max(F.when(F.col(source) == "production", F.col("value"))).alias("production"),
    )
    positives = flagged.filter(F.col(source) == "production").agg(F.coalesce(F.sum("_guess"), F.lit(0))).scalar()
    return wide.withColumn("difference", F.col("production") - F.col("reference")).withColumn(
        "note", F.when(positives == 0, "no positive predictions")
    )


def recommendations(summary: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Rule-based advice from the drift share and the change in accuracy."""
    pct = 100.0 * F.col("drift_share")
    drift = F.when(pct > HIGH_DRIFT_PCT, "high_drift").when(pct > MODERATE_DRIFT_PCT, "moderate_drift").otherwise("low_drift")
    rules: list[Column] = [drift]
    if performance is not None:
        row = performance.filter(F.col("metric") == "accuracy").select(F.struct("difference", "note")).scalar()
        change = row.getField("difference")
        rules += [
            F.when(row.getField("note").isNotNull(), "no_positive_predictions"),
            F.when(change < -ACCURACY_SHIFT, "performance_degradation"),
            F.when(change > ACCURACY_SHIFT, "unexpected_improvement"),
        ]
    advice = {
        "high_drift": "retrain on recent data",
        "moderate_drift": "watch model performance closely",
        "low_drift": "nothing to do",
        "no_positive_predictions": "lower the cut or retrain on balanced data",
        "performance_degradation": "check feature importance and retrain",
        "unexpected_improvement": "check for leaked labels or sampling bias",
    }
    text = F.create_map(*[F.lit(x) for kv in advice.items() for x in kv])
    found = summary.select(F.explode(F.array_compact(F.array(*rules))).alias("finding"))
    return found.withColumn("advice", F.element_at(text, F.col("finding")))


def monitoring_report(drift: DataFrame, performance: DataFrame, advice: DataFrame) -> DataFrame:
    """Everything in one long table (section, name, value)."""
    p = performance.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"performance_{c}").alias("section"),
                        F.col("metric").alias("name"),
                        F.col(c).alias("value"),
                    )
                    for c in ("reference", "production", "difference")
                ]
            )
        )
    )
    d = drift.select(
        F.inline(
            F.array(
                F.struct(F.lit("drift_statistic").alias("section"), F.col("feature").alias("name"), F.col("ks_statistic").alias("value")),
                F.struct(F.lit("drift_p_value").alias("section"), F.col("feature").alias("name"), F.col("p_value").alias("value")),
            )
        )
    )
    a = advice.select(F.lit("recommendation").alias("section"), F.col("finding").alias("name"), F.lit(1.0).alias("value"))
    return p.unionByName(d).unionByName(a)
