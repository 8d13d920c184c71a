"""Counts, curves, sweeps and losses of a scored table (label 0/1, score double)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalar import bucket_of, ratio
from txrisk.operators.ordering import exact_quantiles, fetch_quantiles, prefix_sums, stored

# The grids the sweeps are defined on.
SWEEP_GRID = np.linspace(0, 1, 100).tolist()
COARSE_GRID = np.arange(0.1, 1.0, 0.1).tolist()
COST_GRID = np.linspace(0.01, 0.99, 99).tolist()
RECALL_TARGETS = np.linspace(0.5, 1.0, 11).tolist()
ANOMALY_PERCENTILES = list(range(75, 100))
LOSS_EPSILON = 1e-7


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """accuracy, precision, recall, F1 from the four counts; 0 where undefined."""
    return {
        "accuracy": _or_zero(ratio(tp + tn, tp + tn + fp + fn)),
        "precision": _or_zero(ratio(tp, tp + fp)),
        "recall": _or_zero(ratio(tp, tp + fn)),
        "f1": _or_zero(ratio(2 * tp, 2 * tp + fp + fn)),
    }


# ---- counts ----------------------------------------------------------------------------


def confusion_matrix(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp (per ``keys``)."""
    actual, guess = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    return df.groupBy(*keys).agg(
        F.count_if(~actual & ~guess).alias("tn"),
        F.count_if(~actual & guess).alias("fp"),
        F.count_if(actual & ~guess).alias("fn"),
        F.count_if(actual & guess).alias("tp"),
    )


def binary_metrics(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long table (keys..., metric, value)."""
    counts = confusion_matrix(df, label, predicted, keys)
    metrics = metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics.items()])
    return counts.select(*keys, F.inline(entries))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, F1, support per class, then accuracy, macro and weighted averages."""
    c = confusion_matrix(df, label, predicted)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    zero, one = metric_columns(tn, fn, fp, tp), metric_columns(tp, fp, fn, tn)
    n0, n1, names = tn + fp, tp + fn, ("precision", "recall", "f1")

    def row(section: str, values: Sequence[Column], support: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), *[v.alias(n) for n, v in zip(names, values)], support.alias("support")
        )

    accuracy = one["accuracy"]
    macro = [(zero[m] + one[m]) / 2 for m in names]
    weighted = [_or_zero(ratio(zero[m] * n0 + one[m] * n1, n0 + n1)) for m in names]
    return c.select(
        F.inline(
            F.array(
                row("0", [zero[m] for m in names], n0),
                row("1", [one[m] for m in names], n1),
                row("accuracy", [accuracy] * 3, n0 + n1),
                row("macro avg", macro, n0 + n1),
                row("weighted avg", weighted, n0 + n1),
            )
        )
    )


def compare_models(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """Metrics of two prediction columns side by side, from one pass."""
    flags = F.array(
        F.struct(F.lit("first").alias("model"), F.col(first).cast("int").alias("guess")),
        F.struct(F.lit("second").alias("model"), F.col(second).cast("int").alias("guess")),
    )
    long = df.select(F.col(label), F.inline(flags))
    table = binary_metrics(long, label, "guess", ["model"])
    return table.groupBy("metric").agg(
        F.max(F.when(F.col("model") == "first", F.col("value"))).alias("first"),
        F.max(F.when(F.col("model") == "second", F.col("value"))).alias("second"),
    )


def error_analysis(df: DataFrame, label: str, score: str, values: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Count and mean/deviation of the given columns per outcome (TP, FP, FN, TN)."""
    actual, guess = F.col(label).cast("int") == 1, F.col(score) >= cut
    outcome = F.when(actual & guess, "TP").when(guess, "FP").when(actual, "FN").otherwise("TN")
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return df.withColumn("outcome", outcome).groupBy("outcome").agg(*aggs)


def misclassified(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """The wrong rows themselves, marked FP or FN."""
    guess = (F.col(score) >= cut).cast("int")
    wrong = df.filter(guess != F.col(label).cast("int"))
    return wrong.withColumn("error_type", F.when(guess == 1, "FP").otherwise("FN"))


# ---- curves ----------------------------------------------------------------------------


def score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positives and negatives: the map-side combined base of all curves."""
    positive = F.col(label).cast("int") == 1
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def ranked_scores(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Score counts with tp/fp at "score >= threshold" and the class totals."""
    falling, rows = stored(score_counts(df, score, label, keys).withColumn("_key", -F.col("threshold")))
    sums = prefix_sums(falling, keys, ["_key"], {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True, rows=rows, kept=True)
    return sums.drop("_key")


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    r = ranked_scores(df, score, label)
    return r.select(
        "threshold",
        _or_zero(ratio(F.col("fp"), F.col("fp_total"))).alias("fpr"),
        _or_zero(ratio(F.col("tp"), F.col("tp_total"))).alias("tpr"),
    )


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 with a single class."""
    r = ranked_scores(df, score, label, keys)
    # Per score: its negatives beat by all higher positives and half of the tied ones.
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = F.max("tp_total").cast("double") * F.max("fp_total")
    return r.groupBy(*keys).agg(_or_zero(F.try_divide(area, pairs)).alias("auc"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    r = ranked_scores(df, score, label)
    return r.select(
        "threshold",
        _or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        _or_zero(ratio(F.col("tp"), F.col("tp_total"))).alias("recall"),
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    r = ranked_scores(df, score, label)
    step = ratio(F.col("pos"), F.col("tp_total")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return r.agg(_or_zero(F.sum(step)).alias("average_precision"))


def best_f1_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the highest F1 (the smallest on ties); 0.5 for an empty table."""
    r = ranked_scores(df, score, label)
    f1 = _or_zero(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("tp_total")))
    best = r.agg(F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), _or_zero(F.col("b.f1")).alias("f1"))


# ---- sweeps ----------------------------------------------------------------------------


def threshold_counts(df: DataFrame, score: str, label: str, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at each grid value from one histogram with len(grid) + 1 buckets."""
    positive = F.col(label).cast("int") == 1
    edges = [float(g) for g in grid]
    hist = (
        df.filter(F.col(score).isNotNull())
        .select(*keys, bucket_of(F.col(score), edges).alias("bucket"), positive.alias("_p"))
        .groupBy(*keys, "bucket")
        .agg(F.count_if(F.col("_p")).alias("pos"), F.count_if(~F.col("_p")).alias("neg"))
    )
    flagged = F.col("bucket") > F.col("idx")
    spread = hist.select(*keys, "bucket", "pos", "neg", F.posexplode(F.lit(edges)).alias("idx", "threshold"))
    if not keys and edges:
        # Without a scored row there is no bucket; the grid is there all the same, with zeros.
        grid_rows = df.sparkSession.range(1).select(F.posexplode(F.lit(edges)).alias("idx", "threshold"))
        zero = [F.lit(0).cast(hist.schema[c].dataType).alias(c) for c in ("bucket", "pos", "neg")]
        spread = spread.unionByName(grid_rows.select("idx", "threshold", *zero))
    return spread.groupBy(*keys, "idx", "threshold").agg(
        F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(flagged, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(flagged, 0).otherwise(F.col("neg"))).alias("tn"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, grid: Sequence[float] = SWEEP_GRID) -> DataFrame:
    """accuracy, precision, recall, F1 at each grid value."""
    counts = threshold_counts(df, score, label, grid)
    return counts.select(
        "idx", "threshold", *[c.alias(n) for n, c in metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()]
    )


def cost_sweep(
    df: DataFrame, score: str, label: str, amount: float = 500.0, fp_ratio: float = 0.1, fn_ratio: float = 1.0,
    grid: Sequence[float] = COST_GRID,
) -> DataFrame:
    """Money lost to false alarms and to missed frauds at each grid value."""
    counts = threshold_counts(df, score, label, grid)
    metrics = metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    fp_cost, fn_cost = F.col("fp") * F.lit(amount) * F.lit(fp_ratio), F.col("fn") * F.lit(amount) * F.lit(fn_ratio)
    return counts.select(
        "idx",
        "threshold",
        fp_cost.alias("fp_cost"),
        fn_cost.alias("fn_cost"),
        (fp_cost + fn_cost).alias("total_cost"),
        *[metrics[m].alias(m) for m in ("precision", "recall", "f1")],
        (F.col("tp") + F.col("fn")).alias("fraud_rows"),
    )


def cost_optimal_threshold(sweep: DataFrame) -> DataFrame:
    """The cheapest grid value, the smaller one on ties."""
    return sweep.orderBy("total_cost", "idx").limit(1).select("threshold", "total_cost")


def savings_by_recall(
    sweep: DataFrame, targets: Sequence[float] = RECALL_TARGETS, amount: float = 500.0, fn_ratio: float = 1.0
) -> DataFrame:
    """For each target recall the grid value that comes closest, and what it saves over no model."""
    grid = sweep.select("*", F.explode(F.lit([float(t) for t in targets])).alias("target_recall"))
    distance = F.abs(F.col("recall") - F.col("target_recall"))
    saving = F.col("fraud_rows") * F.lit(amount) * F.lit(fn_ratio) - F.col("total_cost")
    pick = F.min_by(F.struct("threshold", saving.alias("saving")), F.struct(distance, F.col("idx")))
    return grid.groupBy("target_recall").agg(pick.alias("p")).select("target_recall", "p.threshold", "p.saving")


def anomaly_threshold_sweep(
    df: DataFrame, score: str, label: str, percentiles: Sequence[int] = ANOMALY_PERCENTILES
) -> DataFrame:
    """Precision, recall, F1 with the cut at each percentile of the non-fraud scores."""
    normal = df.filter(F.col(label).cast("int") == 0)
    cuts = fetch_quantiles(normal, score, [p / 100 for p in percentiles]) or []
    if not cuts:
        return df.sparkSession.createDataFrame(
            [], "percentile int, threshold double, precision double, recall double, f1 double"
        )
    metrics = metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    counts = threshold_counts(df, score, label, cuts)
    return counts.select(
        F.element_at(F.lit(list(percentiles)), F.col("idx") + 1).alias("percentile"),
        "threshold",
        *[metrics[m].alias(m) for m in ("precision", "recall", "f1")],
    )


def best_anomaly_threshold(df: DataFrame, score: str, label: str, fallback: int = 95) -> DataFrame:
    """Winning (percentile, threshold): first best F1; the fallback percentile when no cut finds a
    fraud; the median of all scores when there is no normal row."""
    swept = anomaly_threshold_sweep(df, score, label)
    best = swept.orderBy(F.col("f1").desc(), "percentile").limit(1).collect()
    spark = df.sparkSession
    if best and best[0]["f1"] > 0:
        result = (best[0]["percentile"], best[0]["threshold"], best[0]["f1"])
    elif best:
        cut = fetch_quantiles(df.filter(F.col(label).cast("int") == 0), score, [fallback / 100])
        result = (fallback, cut[0], 0.0)
    else:
        cut = fetch_quantiles(df, score, [0.5])
        result = (50, cut[0] if cut else None, 0.0)
    return spark.createDataFrame([result], "percentile int, threshold double, f1 double")


def fit_anomaly_threshold(df: DataFrame, score: str, label: str, percentile: float = 95.0) -> DataFrame:
    """The given percentile of the non-fraud scores, linearly interpolated."""
    normal = df.filter(F.col(label).cast("int") == 0)
    return exact_quantiles(normal, score, [percentile / 100]).select(F.get("quantiles", F.lit(0)).alias("threshold"))


# ---- losses ----------------------------------------------------------------------------


def _terms(label: Column, p: Column) -> tuple[Column, Column, Column]:
    """(y, clipped p, cross-entropy)."""
    y = label.cast("double")
    q = F.least(F.greatest(p.cast("double"), F.lit(LOSS_EPSILON)), F.lit(1.0 - LOSS_EPSILON))
    return y, q, -(y * F.log(q) + (1 - y) * F.log(1 - q))


def loss_bce(label: Column, p: Column) -> Column:
    return _terms(label, p)[2]


def loss_focal(label: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25, positive_only: bool = False) -> Column:
    """alpha_t (1 - p_t)^gamma CE. ``positive_only`` leaves the negative class out."""
    y, q, ce = _terms(label, p)
    if positive_only:
        return -F.lit(alpha) * y * F.pow(1 - q, F.lit(gamma)) * F.log(q)
    pt = y * q + (1 - y) * (1 - q)
    weight = y * alpha + (1 - y) * (1 - alpha)
    return weight * F.pow(1 - pt, F.lit(gamma)) * ce


def loss_weighted_focal(label: Column, p: Column, gamma: float = 2.0, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    y, q, ce = _terms(label, p)
    pt = y * q + (1 - y) * (1 - q)
    return (y * weights[1] + (1 - y) * weights[0]) * F.pow(1 - pt, F.lit(gamma)) * ce


def loss_asymmetric_focal(label: Column, p: Column, gamma_pos: float = 2.0, gamma_neg: float = 4.0) -> Column:
    y, q, _ = _terms(label, p)
    return -(y * F.pow(1 - q, F.lit(gamma_pos)) * F.log(q) + (1 - y) * F.pow(q, F.lit(gamma_neg)) * F.log(1 - q))


def loss_adaptive_focal(label: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25, epoch: int = 0) -> Column:
    """Focal loss whose focus grows with the training epoch."""
    return loss_focal(label, p, gamma * (1 + 0.1 * epoch), alpha)


#: Losses by name, each a function of (label, probability) and its parameters.
LOSSES = {
    "binary_crossentropy": loss_bce,
    "focal": loss_focal,
    "weighted_focal": loss_weighted_focal,
    "asymmetric_focal": loss_asymmetric_focal,
    "adaptive_focal": loss_adaptive_focal,
}


def mean_loss(df: DataFrame, loss: Column) -> DataFrame:
    return df.agg(F.avg(loss).alias("loss"))
