"""Metrics, curves, sweeps, losses, drift: goldens and properties."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import evaluation as ev
from txrisk.operators import explore, importance, monitor
from txrisk.operators.importance import permuted_variants


def flagged(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "label int, predicted int")


def metrics(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_published_confusion_matrix(spark):
    m = metrics(ev.binary_metrics(flagged(spark, 256, 14, 16, 14), "label", "predicted"))
    assert m["accuracy"] == pytest.approx(0.9) and m["precision"] == pytest.approx(0.5)
    assert m["recall"] == pytest.approx(0.4667, abs=1e-4) and m["f1"] == pytest.approx(0.4828, abs=1e-4)


def test_published_classification_report(spark):
    report = {r["section"]: r for r in ev.classification_report(flagged(spark, 270, 0, 6, 24), "label", "predicted").collect()}
    assert report["1"]["precision"] == 1.0 and report["1"]["recall"] == pytest.approx(0.8)
    assert report["1"]["f1"] == pytest.approx(0.8889, abs=1e-4) and report["accuracy"]["f1"] == pytest.approx(0.98)
    assert report["0"]["support"] == 270 and report["1"]["support"] == 30


@pytest.mark.parametrize("counts,want", [((10, 0, 5, 0), (0, 0, 0)), ((0, 10, 0, 5), (1 / 3, 1, 0.5)), ((4, 0, 0, 0), (0, 0, 0))])
def test_one_sided_predictions(spark, counts, want):
    m = metrics(ev.binary_metrics(flagged(spark, *counts), "label", "predicted"))
    assert (m["precision"], m["recall"], m["f1"]) == pytest.approx(want)


def scores(spark, n=300, seed=1, digits=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(digits)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id long, score double, label int")
    return df, s, y


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_equals_pair_counting_also_when_split(spark, small_groups):
    df, s, y = scores(spark)
    assert ev.roc_auc(df, "score", "label").first()[0] == pytest.approx(brute_auc(s, y))


def test_auc_is_invariant_under_monotone_maps(spark):
    df, *_ = scores(spark)
    bent = df.withColumn("score", F.exp(F.col("score") * 3))
    assert ev.roc_auc(df, "score", "label").first()[0] == pytest.approx(ev.roc_auc(bent, "score", "label").first()[0])


def test_auc_edge_cases(spark):
    tied = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 1)], "score double, label int")
    assert ev.roc_auc(tied, "score", "label").first()[0] == 0.5
    single = tied.withColumn("label", F.lit(0))
    assert ev.roc_auc(single, "score", "label").first()[0] == 0.0
    assert ev.average_precision(single, "score", "label").first()[0] == 0.0


def test_best_f1_takes_the_smallest_threshold_on_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 1)], "score double, label int")
    row = ev.best_f1_threshold(df, "score", "label").first()
    assert row["threshold"] == 0.4 and row["f1"] == pytest.approx(0.8)
    empty = ev.best_f1_threshold(df.limit(0), "score", "label").first()
    assert empty["threshold"] == 0.5


def test_sweep_counts_scores_on_the_edge(spark):
    df = spark.createDataFrame([(0.5, 1), (0.49, 0)], "score double, label int")
    row = ev.threshold_counts(df, "score", "label", [0.5]).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 0, 0, 1)


def test_cost_sweep_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1), (0.6, 0)], "score double, label int")
    at = {round(r["threshold"], 2): r for r in ev.cost_sweep(df, "score", "label").collect()}
    assert at[0.5]["fp_cost"] == pytest.approx(50) and at[0.5]["fn_cost"] == pytest.approx(500)
    best = ev.cost_optimal_threshold(ev.cost_sweep(df, "score", "label")).first()
    assert best["threshold"] == pytest.approx(0.01) and best["total_cost"] == pytest.approx(50)
    savings = {round(r["target_recall"], 2): r for r in ev.savings_by_recall(ev.cost_sweep(df, "score", "label")).collect()}
    assert savings[1.0]["threshold"] == pytest.approx(0.01) and savings[1.0]["saving"] == pytest.approx(950)
    assert savings[0.5]["threshold"] == pytest.approx(0.21)


def test_anomaly_threshold_fallbacks(spark):
    frauds = spark.createDataFrame([(1.0, 1), (3.0, 1)], "score double, label int")
    assert ev.best_anomaly_threshold(frauds, "score", "label").first()["threshold"] == 2.0
    normals = spark.createDataFrame([(float(i), 0) for i in range(101)], "score double, label int")
    row = ev.best_anomaly_threshold(normals, "score", "label").first()
    assert (row["percentile"], row["threshold"]) == (95, 95.0)


def test_winning_percentile_is_reported(spark):
    rows = [(float(i), 0) for i in range(100)] + [(98.5, 1), (99.5, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    row = ev.best_anomaly_threshold(df, "score", "label").first()
    assert row["percentile"] == 99 and row["f1"] > 0.5


def test_losses_reduce_to_cross_entropy(spark):
    df, *_ = scores(spark)
    y, p = F.col("label"), F.col("score")
    bce = ev.mean_loss(df, ev.loss_bce(y, p)).first()[0]
    assert ev.mean_loss(df, 2 * ev.loss_focal(y, p, gamma=0.0, alpha=0.5)).first()[0] == pytest.approx(bce)
    assert ev.mean_loss(df, ev.loss_weighted_focal(y, p, gamma=0.0)).first()[0] == pytest.approx(bce)
    assert ev.mean_loss(df, ev.loss_asymmetric_focal(y, p, 0.0, 0.0)).first()[0] == pytest.approx(bce)
    flat, late = (ev.mean_loss(df, ev.loss_adaptive_focal(y, p, epoch=e)).first()[0] for e in (0, 10))
    assert late < flat


def test_ks_of_a_sample_with_itself(spark):
    df, *_ = scores(spark)
    row = monitor.ks_drift(df, df, ["score"]).first()
    assert row["ks_statistic"] == 0 and row["p_value"] == 1.0 and not row["drift_detected"]


def test_ks_is_symmetric_and_right(spark, small_groups):
    a, s1, _ = scores(spark, seed=1)
    b, s2, _ = scores(spark, n=200, seed=5)
    b = b.withColumn("score", F.col("score") + 0.1)
    s2 = s2 + 0.1
    grid = np.unique(np.concatenate([s1, s2]))
    want = max(abs((s1 <= g).mean() - (s2 <= g).mean()) for g in grid)
    one, two = monitor.ks_drift(a, b, ["score"], method="asymptotic").first(), monitor.ks_drift(b, a, ["score"], method="asymptotic").first()
    assert one["ks_statistic"] == pytest.approx(want) == pytest.approx(two["ks_statistic"])
    lam = want * math.sqrt(300 * 200 / 500)
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))
    assert one["p_value"] == pytest.approx(min(1, max(0, p)))


def test_drift_share_counts_tested_features_only(spark):
    a, *_ = scores(spark)
    b = a.withColumn("score", F.col("score") + 5)
    text = a.withColumn("name", F.lit("x"))
    drift = monitor.ks_drift(text, b.withColumn("name", F.lit("y")), ["score", "label", "name"])
    row = monitor.drift_summary(drift).first()
    assert (row["tested"], row["drifted"], row["drifted_features"]) == (2, 1, "score")
    found = [r["finding"] for r in monitor.recommendations(monitor.drift_summary(drift)).collect()]
    assert found == ["moderate_drift"]


def test_performance_note_and_degradation(spark):
    rows = [("reference", 1, 0.9), ("reference", 0, 0.1), ("production", 1, 0.1), ("production", 0, 0.1)]
    df = spark.createDataFrame(rows, "source string, label int, score double")
    perf = monitor.monitor_performance(df, "source", "label", "score")
    assert {r["note"] for r in perf.collect()} == {"no positive predictions"}
    a, *_ = scores(spark)
    advice = monitor.recommendations(monitor.drift_summary(monitor.ks_drift(a, a, ["score"])), perf)
    assert [r["finding"] for r in advice.collect()] == ["low_drift", "no_positive_predictions", "performance_degradation"]


def test_permutation_is_a_permutation(spark, small_groups):
    df, s, y = scores(spark, digits=4)
    df = df.withColumn("other", F.col("id") * 1.0)
    long = permuted_variants(df, ["score", "other"], "id", "x")
    for variant, moved in ((0, "score"), (1, "other")):
        part = long.filter(F.col("variant") == variant)
        got = sorted(r[0] for r in part.select(moved).collect())
        assert got == sorted(r[0] for r in df.select(moved).collect())
        joined = part.select("id", F.col(moved).alias("m")).join(df.select("id", moved), "id")
        assert joined.filter(F.col("m") == F.col(moved)).count() < 30


def test_unused_feature_has_no_importance(spark):
    df, *_ = scores(spark)
    df = df.withColumn("noise", F.col("id") * 1.0)
    out = importance.permutation_importance(
        df.withColumnRenamed("score", "signal"), ["signal", "noise"], "id", lambda t: t.withColumn("score", F.col("signal")), "label", repeats=2
    )
    got = {r["feature"]: r["importance"] for r in out.collect()}
    assert got["noise"] == 0.0 and got["signal"] > 0.05


@pytest.mark.parametrize("m,n", [(3, 3), (4, 6), (5, 3), (6, 6), (2, 7)])
def test_exact_ks_equals_enumeration(m, n):
    """Every order of m and n values; the share whose statistic is at least the given one."""
    seen = []
    for places in itertools.combinations(range(m + n), m):
        i = j = 0
        worst = 0.0
        for at in range(m + n):
            i, j = (i + 1, j) if at in places else (i, j + 1)
            worst = max(worst, abs(i / m - j / n))
        seen.append(worst)
    for d in sorted(set(seen)):
        assert monitor.exact_ks_p(d, m, n) == pytest.approx(sum(w >= d - 1e-12 for w in seen) / len(seen))


def test_exact_and_asymptotic_p_meet_for_large_samples(spark):
    rng = np.random.default_rng(2)
    a, b = ([(float(v),) for v in rng.normal(shift, 1, 3000)] for shift in (0.0, 0.04))
    one, two = spark.createDataFrame(a, "v double"), spark.createDataFrame(b, "v double")
    exact, rough = (monitor.ks_drift(one, two, ["v"], method=m).first()["p_value"] for m in ("auto", "asymptotic"))
    assert exact != rough and exact == pytest.approx(rough, abs=0.02)
    assert 0 < monitor.exact_ks_p(1.0, 200, 200) < 1e-100


def test_drift_histograms_of_several_features_in_one_go(spark):
    rng = np.random.default_rng(3)
    old, new = (spark.createDataFrame([(float(a), float(b), float("nan")) for a, b in rng.normal(s, 1, (300, 2))], "f1 double, f2 double, f3 double") for s in (0.0, 2.0))
    drift = monitor.ks_drift(old, new, ["f1", "f2"])
    got = {tuple(r) for r in monitor.drift_histograms(old, new, drift, bins=8).select("feature", "source", "bucket", "n").collect()}
    want = set()
    for f in ("f1", "f2"):
        pair = old.select(F.lit("reference").alias("s"), F.col(f).alias("v")).union(new.select(F.lit("production"), f))
        want |= {(f, r["s"], r["bucket"], r["n"]) for r in explore.histogram_by_label(pair, "v", "s", 8).collect()}
    assert got == want


def test_wide_correlations_equal_pairwise_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 300)) * 10.0 ** rng.integers(-3, 4, 300) + 1000
    x[:, 7] = 5.0
    x[:, 11] = 2 * x[:, 10] + 1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 13] = np.nan
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(4)
    got = {(r["a"], r["b"]): r["corr"] for r in explore.correlation_matrix(df, names).collect()}
    assert len(got) == 300 * 300
    some = [0, 7, 10, 11, 13, 64, 127, 128, 299]
    want = {(r["a"], r["b"]): r["corr"] for r in explore.correlation_matrix(df, [names[i] for i in some]).collect()}
    for pair, value in want.items():
        if value is None:
            assert got[pair] is None, pair
        else:
            assert got[pair] == pytest.approx(value, abs=1e-9), pair
    assert got["c10", "c11"] == pytest.approx(1.0)
