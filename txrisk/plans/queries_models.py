"""Queries: training, scoring, evaluation, monitoring, streaming."""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.datasets import LEDGER_SQL, SCORED_SQL, TX_SQL, VECTORS_SQL, ledger, scored, transactions, vectors
from txrisk.functions import scalar
from txrisk.functions.vectors import linear_score
from txrisk.operators import evaluation as ev
from txrisk.operators import clean, importance, models, monitor, prep, scoring, scoring_set
from txrisk.operators.sequence import HISTORY_COLUMNS
from txrisk.plans import pipeline, queries_features
from txrisk.plans.registry import R, query, r, rand_sql, rounded
from txrisk.session import scratch_path, settings
from txrisk.streaming import history as stream_history
from txrisk.streaming import scoring as stream_scoring
from txrisk.streaming import sources as stream_sources


def _tx(sql: str) -> str:
    return f"WITH {TX_SQL} {sql}"


def _sc(sql: str) -> str:
    return f"WITH {SCORED_SQL} {sql}"


# ---- training --------------------------------------------------------------------------


# What a fit finds can't be said in SQL. The queries below return what must hold of it: the SQL counterpart has the
# counts and shares that follow from the data alone, and "true" for a condition that the query recomputes.

_TEST_ROWS = "count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM vectors"


def _vec(sql: str) -> str:
    return f"WITH {VECTORS_SQL} {sql}"


def _split_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = prep.split_stratified(vectors(spark, d), "label", "id")
    return split.filter("split <> 'test'"), split.filter("split = 'test'")


@query(
    "train_classifier",
    _vec(f"""SELECT kind, (round_even(0.2 * pos, 0) + round_even(0.2 * neg, 0))::BIGINT AS test_rows, true AS in_unit_interval, true AS better_than_constant
        FROM (SELECT {_TEST_ROWS}), (VALUES ('mlp'), ('logistic'), ('gbt')) k(kind)"""),
)
def _(spark, d):
    """Probabilities for the held-out rows, and a smaller loss on the training rows than their base rate has."""
    train, test = _split_vectors(spark, d)
    share = train.agg(F.avg("label").alias("share")).first()["share"]
    rows = []
    for kind in ("mlp", "logistic", "gbt"):
        model = models.train_classifier(train, kind, (8,), l2=0.0, max_iter=15)
        out = scoring.score_probability(models.as_vectors(test), model)
        fitted = scoring.score_probability(models.as_vectors(train), model).agg(
            F.avg(ev.loss_bce(F.col("label"), F.col("fraud_probability"))).alias("l"), F.avg(ev.loss_bce(F.col("label"), F.lit(share))).alias("c")
        )
        inside = out.agg(F.count(F.lit(1)).alias("test_rows"), F.min(F.col("fraud_probability").between(0, 1)).alias("in_unit_interval"))
        better = fitted.select(F.col("l") < F.col("c")).scalar()
        rows.append(inside.select(F.lit(kind).alias("kind"), "test_rows", "in_unit_interval", better.alias("better_than_constant")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "train_weighted",
    _vec(f"""SELECT form, label, CASE WHEN label = 1 THEN pos ELSE neg END AS n, {R('weight', 6)} AS weight, {R('share', 3)} AS weighted_probability FROM (
        SELECT 'balanced' AS form, label, (pos + neg) / (2.0::DOUBLE * CASE WHEN label = 1 THEN pos ELSE neg END) AS weight, 0.5::DOUBLE AS share, pos, neg
        FROM (SELECT {_TEST_ROWS}), (VALUES (0), (1)) l(label)
        UNION ALL SELECT 'ratio', label, CASE WHEN label = 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END, 4.0::DOUBLE * pos / (4 * pos + neg), pos, neg
        FROM (SELECT {_TEST_ROWS}), (VALUES (0), (1)) l(label))"""),
)
def _(spark, d):
    """The weights of both forms. At the optimum the weighted mean probability is the weighted share of label 1."""
    v, parts = vectors(spark, d), []
    for form, ratio in (("balanced", None), ("ratio", 4.0)):
        model = models.train_weighted(v, "logistic", l2=0.01, max_iter=100, ratio=ratio)
        scored_rows = scoring.score_probability(models.as_vectors(models.with_class_weights(v, ratio=ratio)), model)
        whole = scored_rows.agg((F.sum(F.col("weight") * F.col("fraud_probability")) / F.sum("weight")).alias("weighted_probability"))
        table = scored_rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), r(F.max("weight")).alias("weight"))
        parts.append(table.select(F.lit(form).alias("form"), "label", "n", "weight", r(whole.scalar(), 3).alias("weighted_probability")))
    return parts[0].unionByName(parts[1])


_LOSS_FORMS = {
    "binary_crossentropy": {},
    "focal": {"gamma": 2.0, "alpha": 0.25},
    "weighted_focal": {"gamma": 2.0, "weights": (1.0, 4.0)},
    "asymmetric_focal": {"gamma_pos": 2.0, "gamma_neg": 4.0},
    "adaptive_focal": {"gamma": 2.0, "alpha": 0.25, "epoch": 5},
}


@query(
    "train_focal",
    _vec(f"SELECT loss, pos + neg AS rows, true AS below_reweighted, true AS nothing_near_is_lower FROM (SELECT {_TEST_ROWS}), (VALUES {', '.join(f'($${n}$$)' for n in _LOSS_FORMS)}) l(loss)"),
)
def _(spark, d):
    """Every loss at its fit: no higher than at the log-loss fit with the same penalty, nor than a little beside it."""
    v = vectors(spark, d)
    plain = models.train_classifier(v, "logistic", l2=0.01, max_iter=100)
    moments = models.as_vectors(v).select(models.Summarizer.std(F.col("features")).alias("s")).first()["s"].toArray()
    parts = []
    for name, parameters in _LOSS_FORMS.items():
        model = models.train_loss(v, name, l2=0.01, max_iter=12, **parameters)

        def at(weights, intercept, name=name, parameters=parameters):
            x = F.aggregate(F.zip_with("features", F.lit([float(w) for w in weights]), lambda a, w: a * w), F.lit(float(intercept)), lambda a, b: a + b)
            penalty = 0.005 * float(((weights * moments) ** 2).sum())
            return F.avg(ev.LOSSES[name](F.col("label"), 1 / (1 + F.exp(-x)), **parameters)) + penalty

        w, b = model.coefficients.toArray(), model.intercept
        beside = [at(w, b + step) for step in (-0.05, 0.05)]
        beside += [at(w + step * np.eye(len(w))[i] / moments[i], b) for i in (0, 31, 63) for step in (-0.05, 0.05)]
        own, other = at(w, b).alias("own"), at(plain.coefficients.toArray(), plain.intercept).alias("plain")
        row = v.agg(F.count(F.lit(1)).alias("rows"), own, other, F.least(*beside).alias("beside"))
        parts.append(row.select(F.lit(name).alias("loss"), "rows", (F.col("own") <= F.col("plain") + 1e-9).alias("below_reweighted"), (F.col("own") <= F.col("beside") + 1e-9).alias("nothing_near_is_lower")))
    return reduce(DataFrame.unionByName, parts)


_GRID = {"hidden": [[8], [16, 8]], "stepSize": [0.01, 0.1]}
_GRID_SQL = ", ".join(f"({i}, '{{\"hidden\": {h}, \"stepSize\": {s}}}')" for i, (h, s) in enumerate(itertools.product(*_GRID.values())))


@query(
    "tune_classifier",
    _vec(f"""SELECT point, parameters, n AS validation_rows, true AS auc_of_its_scores, true AS best_has_the_highest
        FROM (SELECT count(*) AS n FROM vectors WHERE {rand_sql('id', 42)} < 0.25), (VALUES {_GRID_SQL}) g(point, parameters)"""),
)
def _(spark, d):
    """Layers x step size; every point's AUC again, as the share of pairs in order, from the stored scores."""
    done = models.tune_classifier(vectors(spark, d), _GRID, max_iter=8)
    ranked = done.scores.withColumn("rank", F.percent_rank().over(Window.partitionBy("point").orderBy("score")))
    sizes = done.scores.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    # percent_rank is (rank - 1) / (n - 1) with the least rank of ties; half of the other ties are added.
    ties = done.scores.groupBy("point", "score").agg(F.count(F.lit(1)).alias("same"))
    summed = ranked.join(ties, ["point", "score"]).join(sizes, "point").filter("label = 1")
    place = F.col("rank") * (F.col("n") - 1) + 1 + (F.col("same") - 1) / 2
    plain = summed.groupBy("point").agg(
        ((F.sum(place) - F.max("pos") * (F.max("pos") + 1) / 2) / (F.max("pos") * (F.max("n") - F.max("pos")))).alias("plain"), F.max("n").alias("validation_rows")
    )
    top = done.points.agg(F.max("auc")).first()[0]
    chosen = json.dumps(done.best, sort_keys=True)
    best = done.points.filter(F.col("parameters") == chosen).first()["auc"]
    return done.points.join(plain, "point").select(
        "point", "parameters", "validation_rows", (F.abs(F.col("auc") - F.col("plain")) < 1e-9).alias("auc_of_its_scores"), F.lit(bool(best == top)).alias("best_has_the_highest")
    )


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return models.train_reconstructor(v, 8).transform(v)


@query(
    "train_reconstructor",
    _vec(f"""SELECT i AS dimension, {R('avg(x)')} AS mean, {R('stddev_samp(x)')} AS scale, true AS orthonormal, true AS below_best_coordinates
        FROM (SELECT unnest(features) AS x, unnest(range(64)) AS i FROM vectors WHERE label = 0) GROUP BY i"""),
)
def _(spark, d):
    """Mean and deviation of the normal rows; axes of length one at right angles, with less error than any 8 coordinates leave."""
    v = vectors(spark, d)
    fitted = models.train_reconstructor(v, 8)
    straight = bool(np.allclose(fitted.axes.T @ fitted.axes, np.eye(8), atol=1e-9))
    error = scoring.anomaly_score(fitted.transform(v.filter("label = 0")), "scaled", "rebuilt").agg(F.avg("anomaly_score")).first()[0]
    n = v.filter("label = 0").count()
    # Each scaled coordinate has variance (n - 1) / n; keeping eight of 64 leaves the others.
    rows = [(i, float(m), float(s), straight, bool(error < 56 / 64 * (n - 1) / n)) for i, (m, s) in enumerate(zip(fitted.mean, fitted.scale))]
    out = spark.createDataFrame(rows, "dimension long, mean double, scale double, orthonormal boolean, below_best_coordinates boolean")
    return rounded(out, "mean", "scale")


@query(
    "fit_anomaly_threshold",
    _sc(f"SELECT {R('quantile_cont(anomaly_score, 0.95)')} AS threshold FROM scored WHERE label = 0"),
)
def _(spark, d):
    return rounded(ev.fit_anomaly_threshold(scored(spark, d), "anomaly_score", "label", 95), "threshold")


_JOB_FEATURES = ["amount", "amount_log", "hour_sin", "hour_cos", "velocity_score_norm", "amount_ratio", "avg_amount_last5", "time_span_days"]
_PARTS_SQL = """parts AS (SELECT is_fraud, n, round_even(0.2 * n, 0)::BIGINT AS test, round_even(0.25 * (n - round_even(0.2 * n, 0)), 0)::BIGINT AS val
    FROM (SELECT is_fraud, count(*) AS n FROM tx GROUP BY 1))"""


def _job_check(done: pipeline.Trained, rows: DataFrame, score: str, cut: float, metrics: DataFrame) -> DataFrame:
    """The metrics of a job against a plain count over its test rows, scored with the set it left behind."""
    test = done.scoring.score(prep.split_stratified(rows, "fraud_label", "transaction_id").filter("split = 'test'"))
    hit, truth = F.col(score) >= cut, F.col("fraud_label") == 1
    plain = test.agg(
        F.count(F.lit(1)).alias("test_rows"), F.count_if(truth).alias("frauds"), F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"), F.count_if(hit == truth).alias("right"),
    ).first()
    told = {m["metric"]: m["value"] for m in metrics.collect()}
    tp, fp, fn = plain["tp"], plain["fp"], plain["frauds"] - plain["tp"]
    want = {
        "accuracy": plain["right"] / max(plain["test_rows"], 1), "precision": tp / max(tp + fp, 1), "recall": tp / max(tp + fn, 1),
        "f1": 2 * tp / max(2 * tp + fp + fn, 1),
    }
    same = all(abs(told[k] - v) < 1e-9 for k, v in want.items())
    return rows.sparkSession.createDataFrame([(plain["test_rows"], plain["frauds"], same)], "test_rows long, frauds long, metrics_recounted boolean")


_JOB_SQL = f", {_PARTS_SQL} SELECT sum(test)::BIGINT AS test_rows, (sum(test) FILTER (is_fraud))::BIGINT AS frauds, true AS metrics_recounted FROM parts"


@query("training_job", _tx(_JOB_SQL))
def _(spark, d):
    features = pipeline.engineer_features(transactions(spark, d))
    done = pipeline.training_job(features, features=_JOB_FEATURES)
    return _job_check(done, features, "fraud_probability", done.threshold, done.metrics)


@query(
    "training_job_smote",
    _tx(f""", {_PARTS_SQL}, t AS (SELECT max(n - test - val) FILTER (is_fraud) AS pos, max(n - test - val) FILTER (NOT is_fraud) AS neg FROM parts)
        SELECT technique, label, (CASE WHEN label = 0 THEN neg WHEN technique = 'none' THEN pos ELSE greatest(pos, floor(0.5 * neg)) END)::BIGINT AS rows, true AS made_in_training
        FROM t, (VALUES ('none'), ('smote')) k(technique), (VALUES (0), (1)) l(label)"""),
)
def _(spark, d):
    """What the fit of a job sees by re-sampling technique: only rows of the training part and rows made from them."""
    seen = _seen(spark, d)
    split = prep.split_stratified(seen, "fraud_label", "transaction_id")
    inside = split.filter("split = 'train'").select(F.col("transaction_id").alias("id"))
    done = pipeline.training_job(seen, features=_SET_FEATURES, technique="smote", loss="focal", ratio=0.5)
    assembled = done.scoring.prepare(split.filter("split = 'train'")).select(
        F.col("transaction_id").alias("id"), F.col("fraud_label").alias("label"), "features"
    )
    parts = []
    for technique in ("none", "smote"):
        rows = pipeline.resampled(assembled, technique, **({"ratio": 0.5} if technique == "smote" else {}))
        marked = rows.join(inside.withColumn("inside", F.lit(True)), "id", "left")
        known = F.col("inside").isNotNull() | F.col("id").isNull()
        parts.append(marked.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.min(known).alias("made_in_training")).select(F.lit(technique).alias("technique"), "label", "rows", "made_in_training"))
    return parts[0].unionByName(parts[1])


@query(
    "anomaly_job",
    _tx(f""", {_PARTS_SQL}, v AS (SELECT val FROM parts WHERE NOT is_fraud)
        SELECT j.*, (SELECT val FROM v) AS normal_validation_rows, ((SELECT val FROM v) - ceil(0.95::DOUBLE * ((SELECT val FROM v) - 1)))::BIGINT AS flagged
        FROM (SELECT sum(test)::BIGINT AS test_rows, (sum(test) FILTER (is_fraud))::BIGINT AS frauds, true AS metrics_recounted FROM parts) j"""),
)
def _(spark, d):
    """Normal rows to a reconstructor, a percentile of the normal validation errors as cut, metrics on the test rows."""
    features = pipeline.engineer_features(transactions(spark, d))
    done = pipeline.training_job(features, features=_JOB_FEATURES, anomaly_axes=3)
    cut = done.scoring.anomaly_cut
    split = prep.split_stratified(features, "fraud_label", "transaction_id").filter("split = 'val' and fraud_label = 0")
    counted = done.scoring.score(split).agg(
        F.count(F.lit(1)).alias("normal_validation_rows"), F.count_if(F.col("anomaly_score") >= cut).alias("flagged")
    )
    checked = _job_check(done, features, "anomaly_score", cut, done.anomaly_metrics)
    return checked.withColumns({c: counted.select(c).scalar() for c in counted.columns})


# ---- scoring ---------------------------------------------------------------------------

_WEIGHTS, _BIAS = [0.02, -0.01, 0.5], -1.0
_MARGIN = "(0.0 + -1.0::DOUBLE + amount * 0.02 + velocity_score * -0.01 + (hour(timestamp) / 24.0::DOUBLE) * 0.5)"
_PROB = f"(1.0::DOUBLE / (1.0 + exp(-{_MARGIN})))"


def _linear_inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("hour_share", F.hour("timestamp") / 24.0)


_LINEAR = ["amount", "velocity_score", "hour_share"]


@query("score_probability", _tx(f"SELECT transaction_id, {R(_PROB)} AS fraud_probability FROM tx"))
def _(spark, d):
    out = scoring.score_linear(_linear_inputs(transactions(spark, d)), _LINEAR, _WEIGHTS, _BIAS)
    return rounded(out.select("transaction_id", "fraud_probability"), "fraud_probability")


@query(
    "anomaly_score",
    f"""WITH {VECTORS_SQL}, m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(features) AS x, unnest(range(1, 65)) AS i FROM vectors) GROUP BY i),
    mm AS (SELECT list(m ORDER BY i) AS m FROM m)
    SELECT id, {R('list_sum(list_transform(list_zip(features, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(features)')} AS anomaly_score FROM vectors, mm""",
)
def _(spark, d):
    # The rebuilt vector here is the column mean: the zero-component reconstruction.
    v = vectors(spark, d)
    long = v.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = long.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).scalar()
    out = scoring.anomaly_score(v.withColumn("rebuilt", mean), "features", "rebuilt")
    return rounded(out.select("id", "anomaly_score"), "anomaly_score")


_FLAGS = ["is_fraud_classification", "is_fraud_anomaly"]
_FLAGS_SQL = """flagged AS (SELECT *, probability AS fraud_probability, probability >= 0.5 AS is_fraud_classification,
  anomaly_score >= 10 AS is_fraud_anomaly, probability >= 0.5 OR anomaly_score >= 10 AS is_fraud_ensemble FROM scored)"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumnRenamed("probability", "fraud_probability")
    return scoring.ensemble_or(scoring.apply_threshold(s, anomaly_cut=10.0))


@query("apply_threshold", _sc(f", {_FLAGS_SQL} SELECT transaction_id, {', '.join(_FLAGS)} FROM flagged"))
def _(spark, d):
    return _flagged(spark, d).select("transaction_id", *_FLAGS)


@query("ensemble_or", _sc(f", {_FLAGS_SQL} SELECT transaction_id, is_fraud_ensemble FROM flagged"))
def _(spark, d):
    return _flagged(spark, d).select("transaction_id", "is_fraud_ensemble")


@query(
    "score_output",
    _sc(
        f""", {_FLAGS_SQL} SELECT transaction_id::VARCHAR AS transaction_id, epoch_us(timestamp) AS us, {R('fraud_probability')} AS fraud_probability,
        {R('anomaly_score')} AS anomaly_score, is_fraud_classification, is_fraud_anomaly, is_fraud_ensemble, merchant_category, amount, label FROM flagged"""
    ),
)
def _(spark, d):
    out = scoring.score_output(_flagged(spark, d), epoch=3)
    out = out.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")
    return rounded(out, "fraud_probability", "anomaly_score")


@query("score_by_model_type", _sc(f", {_FLAGS_SQL} SELECT transaction_id, {R('anomaly_score')} AS anomaly_score, is_fraud_anomaly FROM flagged"))
def _(spark, d):
    return rounded(scoring.score_by_model_type(_flagged(spark, d), "autoencoder"), "anomaly_score")


@query(
    "alert_summary",
    _sc(f", {_FLAGS_SQL} SELECT (transaction_id % 10)::BIGINT AS epoch, count(*) AS rows, count(*) FILTER (is_fraud_ensemble) AS fraud_rows FROM flagged GROUP BY 1"),
)
def _(spark, d):
    return scoring.alert_summary(_flagged(spark, d).withColumn("epoch", F.col("transaction_id") % 10))


# ---- evaluation ------------------------------------------------------------------------

_CM = "count(*) FILTER (label = 0 AND NOT g) AS tn, count(*) FILTER (label = 0 AND g) AS fp, count(*) FILTER (label = 1 AND NOT g) AS fn, count(*) FILTER (label = 1 AND g) AS tp"
_METRICS = {
    "accuracy": "(tp + tn) / nullif(tp + tn + fp + fn, 0)",
    "precision": "tp / nullif(tp + fp, 0)",
    "recall": "tp / nullif(tp + fn, 0)",
    "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
}


def _metric(name: str) -> str:
    expr = _METRICS[name].replace("(tp + tn)", "(tp + tn)::DOUBLE").replace("2 * tp /", "2.0::DOUBLE * tp /")
    expr = expr.replace("tp / nullif", "tp::DOUBLE / nullif", 1) if name in ("precision", "recall") else expr
    return R(f"coalesce({expr}, 0)")


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


_CMQ = f", c AS (SELECT {_CM} FROM (SELECT label, probability >= 0.5 AS g FROM scored))"


@query("confusion_matrix", _sc(f"{_CMQ} SELECT tn, fp, fn, tp FROM c"))
def _(spark, d):
    return ev.confusion_matrix(_guessed(spark, d), "label", "predicted")


@query("binary_metrics", _sc(f"{_CMQ} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_metric(m)} AS value FROM c" for m in _METRICS)))
def _(spark, d):
    return rounded(ev.binary_metrics(_guessed(spark, d), "label", "predicted"), "value")


@query(
    "classification_report",
    _sc(
        f"""{_CMQ}, m AS (SELECT *, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p0, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r0,
          coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p1,
          coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r1, coalesce(2.0::DOUBLE * tp / nullif(2 * tn * 0 + 2 * tp + fn + fp, 0), 0) AS f1,
          tn + fp AS n0, tp + fn AS n1, (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS acc FROM c)
        SELECT '0' AS section, {R('p0')} AS precision, {R('r0')} AS recall, {R('f0')} AS f1, n0 AS support FROM m
        UNION ALL SELECT '1', {R('p1')}, {R('r1')}, {R('f1')}, n1 FROM m
        UNION ALL SELECT 'accuracy', {R('acc')}, {R('acc')}, {R('acc')}, n0 + n1 FROM m
        UNION ALL SELECT 'macro avg', {R('(p0 + p1) / 2')}, {R('(r0 + r1) / 2')}, {R('(f0 + f1) / 2')}, n0 + n1 FROM m
        UNION ALL SELECT 'weighted avg', {R('(p0 * n0 + p1 * n1) / (n0 + n1)')}, {R('(r0 * n0 + r1 * n1) / (n0 + n1)')}, {R('(f0 * n0 + f1 * n1) / (n0 + n1)')}, n0 + n1 FROM m"""
    ),
)
def _(spark, d):
    return rounded(ev.classification_report(_guessed(spark, d), "label", "predicted"), "precision", "recall", "f1")


_CURVE = """, v AS (SELECT probability AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
  t AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM v WINDOW w AS (ORDER BY threshold DESC))"""


@query("roc_curve", _sc(f"{_CURVE} SELECT {R('threshold')} AS threshold, {R('fp::DOUBLE / n')} AS fpr, {R('tp::DOUBLE / p')} AS tpr FROM t"))
def _(spark, d):
    return rounded(ev.roc_curve(scored(spark, d), "probability", "label"), "threshold", "fpr", "tpr")


@query("roc_auc", _sc(f"{_CURVE} SELECT {R('sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n)')} AS auc FROM t"))
def _(spark, d):
    return rounded(ev.roc_auc(scored(spark, d), "probability", "label"), "auc")


@query("pr_curve", _sc(f"{_CURVE} SELECT {R('threshold')} AS threshold, {R('tp::DOUBLE / (tp + fp)')} AS precision, {R('tp::DOUBLE / p')} AS recall FROM t"))
def _(spark, d):
    return rounded(ev.pr_curve(scored(spark, d), "probability", "label"), "threshold", "precision", "recall")


@query("average_precision", _sc(f"{_CURVE} SELECT {R('sum(pos::DOUBLE / p * tp / (tp + fp))')} AS average_precision FROM t"))
def _(spark, d):
    return rounded(ev.average_precision(scored(spark, d), "probability", "label"), "average_precision")


@query(
    "best_f1_threshold",
    _sc(f"{_CURVE} SELECT {R('threshold')} AS threshold, {R('2.0::DOUBLE * tp / (tp + fp + p)')} AS f1 FROM t ORDER BY 2.0::DOUBLE * tp / (tp + fp + p) DESC, t.threshold LIMIT 1"),
)
def _(spark, d):
    return rounded(ev.best_f1_threshold(scored(spark, d), "probability", "label"), "threshold", "f1")


def _grid_sql(grid: list[float], score: str = "probability") -> str:
    values = ", ".join(f"({i}, {g!r}::DOUBLE)" for i, g in enumerate(grid))
    return f""", grid(idx, threshold) AS (VALUES {values}),
      h AS (SELECT idx, threshold, label, {score} >= threshold AS g FROM scored, grid),
      c AS (SELECT idx, threshold, {_CM} FROM h GROUP BY 1, 2)"""


_SWEEP = ", ".join(f"{_metric(m)} AS {m}" for m in _METRICS)


@query("threshold_sweep", _sc(f"{_grid_sql(ev.SWEEP_GRID)} SELECT idx, threshold, {_SWEEP} FROM c"))
def _(spark, d):
    return rounded(ev.threshold_sweep(scored(spark, d), "probability", "label"), *_METRICS)


@query("threshold_sweep_coarse", _sc(f"{_grid_sql(ev.COARSE_GRID)} SELECT idx, threshold, {_SWEEP} FROM c"))
def _(spark, d):
    return rounded(ev.threshold_sweep(scored(spark, d), "probability", "label", ev.COARSE_GRID), *_METRICS)


_COSTS = f"""{_grid_sql(ev.COST_GRID)}, k AS (SELECT *, fp * 500.0::DOUBLE * 0.1::DOUBLE AS fp_cost, fn * 500.0::DOUBLE AS fn_cost,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rec FROM c)"""


@query(
    "cost_sweep",
    _sc(
        f"""{_COSTS} SELECT idx, threshold, {R('fp_cost')} AS fp_cost, {R('fn_cost')} AS fn_cost, {R('fp_cost + fn_cost')} AS total_cost,
        {_metric('precision')} AS precision, {_metric('recall')} AS recall, {_metric('f1')} AS f1, tp + fn AS fraud_rows FROM k"""
    ),
)
def _(spark, d):
    return rounded(ev.cost_sweep(scored(spark, d), "probability", "label"), "fp_cost", "fn_cost", "total_cost", "precision", "recall", "f1")


@query("cost_optimal_threshold", _sc(f"{_COSTS} SELECT threshold, {R('fp_cost + fn_cost')} AS total_cost FROM k ORDER BY fp_cost + fn_cost, idx LIMIT 1"))
def _(spark, d):
    return rounded(ev.cost_optimal_threshold(ev.cost_sweep(scored(spark, d), "probability", "label")), "total_cost")


@query(
    "savings_by_recall",
    _sc(
        f"""{_COSTS}, tgt(target_recall) AS (VALUES {', '.join(f'({t!r}::DOUBLE)' for t in ev.RECALL_TARGETS)}),
        best AS (SELECT target_recall, threshold, (tp + fn) * 500.0::DOUBLE - fp_cost - fn_cost AS saving,
          row_number() OVER (PARTITION BY target_recall ORDER BY abs(rec - target_recall), idx) AS rk FROM k, tgt)
        SELECT target_recall, threshold, {R('saving')} AS saving FROM best WHERE rk = 1"""
    ),
)
def _(spark, d):
    return rounded(ev.savings_by_recall(ev.cost_sweep(scored(spark, d), "probability", "label")), "saving")


_PCTS = ", ".join(f"({p})" for p in ev.ANOMALY_PERCENTILES)
_ANOMALY = f""", q AS (SELECT quantile_cont(anomaly_score, [{', '.join(repr(p / 100) for p in ev.ANOMALY_PERCENTILES)}]) AS qs FROM scored WHERE label = 0),
  cuts AS (SELECT p AS percentile, qs[p - 74] AS threshold FROM q, (VALUES {_PCTS}) v(p)),
  h AS (SELECT percentile, threshold, label, anomaly_score >= threshold AS g FROM scored, cuts),
  c AS (SELECT percentile, threshold, {_CM} FROM h GROUP BY 1, 2)"""


@query(
    "anomaly_threshold_sweep",
    _sc(f"{_ANOMALY} SELECT percentile, {R('threshold')} AS threshold, {_metric('precision')} AS precision, {_metric('recall')} AS recall, {_metric('f1')} AS f1 FROM c"),
)
def _(spark, d):
    return rounded(ev.anomaly_threshold_sweep(scored(spark, d), "anomaly_score", "label"), "threshold", "precision", "recall", "f1")


@query(
    "best_anomaly_threshold",
    _sc(f"{_ANOMALY} SELECT percentile, {R('threshold')} AS threshold, {_metric('f1')} AS f1 FROM c ORDER BY 2.0::DOUBLE * tp / (2 * tp + fp + fn) DESC, percentile LIMIT 1"),
)
def _(spark, d):
    return rounded(ev.best_anomaly_threshold(scored(spark, d), "anomaly_score", "label"), "threshold", "f1")


_GROUPS = "'TP' WHEN g THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN'"


@query(
    "error_analysis",
    _sc(
        f"""SELECT CASE WHEN g AND label = 1 THEN {_GROUPS} END AS outcome, count(*) AS n, {R('avg(amount)')} AS amount_mean,
        {R('stddev_samp(amount)')} AS amount_std FROM (SELECT *, probability >= 0.5 AS g FROM scored) GROUP BY 1"""
    ),
)
def _(spark, d):
    return rounded(ev.error_analysis(scored(spark, d), "label", "probability", ["amount"]), "amount_mean", "amount_std")


@query(
    "error_analysis_rows",
    _sc("SELECT transaction_id, label, CASE WHEN probability >= 0.5 THEN 'FP' ELSE 'FN' END AS error_type FROM scored WHERE (probability >= 0.5)::INTEGER <> label"),
)
def _(spark, d):
    return ev.misclassified(scored(spark, d), "label", "probability").select("transaction_id", "label", "error_type")


@query(
    "compare_models",
    _sc(
        f""", a AS (SELECT {_CM} FROM (SELECT label, probability >= 0.5 AS g FROM scored)), b AS (SELECT {_CM} FROM (SELECT label, anomaly_score >= 10 AS g FROM scored)) """
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, (SELECT {_metric(m)} FROM a) AS first, (SELECT {_metric(m)} FROM b) AS second" for m in _METRICS
        )
    ),
)
def _(spark, d):
    return rounded(ev.compare_models(_flagged(spark, d), "label", *_FLAGS), "first", "second")


_P = "least(greatest(probability, 1e-7), 1 - 1e-7)"
_CE = f"-(label * ln({_P}) + (1 - label) * ln(1 - {_P}))"
_PT = f"(CASE WHEN label = 1 THEN {_P} ELSE 1 - {_P} END)"
_ALPHA = "(CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END)"


def _loss(name: str, sql: str, expr) -> None:
    query(name, _sc(f"SELECT {R(f'avg({sql})')} AS loss FROM scored"))(
        lambda spark, d: rounded(ev.mean_loss(scored(spark, d), expr(F.col("label"), F.col("probability"))), "loss")
    )


_loss("loss_bce", _CE, ev.loss_bce)
_loss("loss_focal", f"{_ALPHA} * pow(1 - {_PT}, 2) * ({_CE})", ev.loss_focal)
_loss(
    "loss_focal_positive_only",
    f"-0.25 * label * pow(1 - {_P}, 2) * ln({_P})",
    lambda y, p: ev.loss_focal(y, p, positive_only=True),
)
_loss(
    "loss_weighted_focal",
    f"(CASE WHEN label = 1 THEN 10 ELSE 1 END) * pow(1 - {_PT}, 2) * ({_CE})",
    lambda y, p: ev.loss_weighted_focal(y, p, weights=(1.0, 10.0)),
)
_loss(
    "loss_asymmetric_focal",
    f"-(label * pow(1 - {_P}, 2) * ln({_P}) + (1 - label) * pow({_P}, 4) * ln(1 - {_P}))",
    ev.loss_asymmetric_focal,
)
_loss(
    "loss_adaptive_focal",
    f"{_ALPHA} * pow(1 - {_PT}, 2.0 * (1 + 0.1 * 3)) * ({_CE})",
    lambda y, p: ev.loss_adaptive_focal(y, p, epoch=3),
)


# ---- importance ------------------------------------------------------------------------


@query(
    "reconstruction_importance",
    f"""WITH {VECTORS_SQL}, x AS (SELECT unnest(features) AS x, unnest(range(0, 64)) AS position FROM vectors),
    m AS (SELECT position, avg(x) AS m FROM x GROUP BY 1)
    SELECT position::INTEGER AS position, {R('avg(abs(x - m))')} AS error FROM x JOIN m USING (position) GROUP BY 1 ORDER BY avg(abs(x - m)) DESC, 1 LIMIT 10""",
)
def _(spark, d):
    v = vectors(spark, d)
    long = v.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = long.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).scalar()
    out = importance.reconstruction_importance(v.withColumn("rebuilt", mean), "features", "rebuilt")
    return rounded(out, "error")


def _perm_sql() -> str:
    order = f"ORDER BY {rand_sql('transaction_id', '0-0')}, transaction_id"
    parts = []
    for j in range(-1, 3):
        cols = [f"{'q' if i == j else ''}{c}" for i, c in enumerate(("a", "v", "h"))]
        parts.append(
            f"SELECT {j} AS variant, y, 1.0::DOUBLE / (1.0 + exp(-(0.0 + -1.0::DOUBLE + {cols[0]} * 0.02 + {cols[1]} * -0.01 + {cols[2]} * 0.5))) AS s FROM o"
        )
    return f""", b AS (SELECT transaction_id, is_fraud::INTEGER AS y, amount AS a, velocity_score AS v, hour(timestamp) / 24.0::DOUBLE AS h FROM tx),
    o AS (SELECT y, a, v, h, """ + ", ".join(
        f"coalesce(lag({c}) OVER ({order}), first({c}) OVER (ORDER BY {rand_sql('transaction_id', '0-0')} DESC, transaction_id DESC)) AS q{c}" for c in "avh"
    ) + f""" FROM b), s AS ({' UNION ALL '.join(parts)}),
    g AS (SELECT variant, s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2),
    t AS (SELECT variant, pos, neg, sum(pos) OVER (PARTITION BY variant ORDER BY s DESC) AS tp FROM g),
    auc AS (SELECT variant, sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM t GROUP BY 1)
    SELECT ['amount', 'velocity_score', 'hour_share'][variant + 1] AS feature,
      {R('(SELECT auc FROM auc WHERE variant = -1) - auc')} AS importance, 0.0::DOUBLE AS importance_std FROM auc WHERE variant >= 0"""


@query("permutation_importance", _tx(_perm_sql()))
def _(spark, d):
    tx = _linear_inputs(transactions(spark, d)).withColumn("label", F.col("is_fraud").cast("int"))

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", linear_score([F.col(c) for c in _LINEAR], _WEIGHTS, _BIAS))

    return rounded(importance.permutation_importance(tx, _LINEAR, "transaction_id", score, "label"), "importance")


@query(
    "permutation_importance_reconstructor",
    _vec("SELECT 'f' || i AS feature, 10::BIGINT AS repeats, true AS as_recomputed FROM (SELECT unnest(range(6)) AS i)"),
)
def _(spark, d):
    """Ten repeats over the errors of a reconstructor; once more from the swapped tables, a repeat at a time."""
    names = [f"f{i}" for i in range(6)]
    v = vectors(spark, d).select("id", "label", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    fitted = models.train_reconstructor(v.withColumn("features", F.array(*names)), 2)

    def score(df: DataFrame) -> DataFrame:
        out = scoring.anomaly_score(fitted.transform(df.withColumn("features", F.array(*names))), "scaled", "rebuilt", "score")
        return out.drop("features", "scaled", "rebuilt")

    told = importance.permutation_importance(v.select("id", *names), names, "id", score, repeats=10)
    base = score(v.select("id", *names)).agg(F.avg("score")).first()[0]
    parts = [score(importance.permuted_variants(v.select("id", *names), names, "id", f"0-{i}")).groupBy("variant").agg(F.avg("score").alias("s")) for i in range(10)]
    again = reduce(DataFrame.unionByName, parts).filter("variant >= 0").groupBy("variant").agg((F.avg("s") - base).alias("again"), F.count(F.lit(1)).alias("repeats"))
    again = again.withColumn("feature", F.concat(F.lit("f"), F.col("variant").cast("string")))
    return told.join(again, "feature").select("feature", "repeats", (F.abs(F.col("importance") - F.col("again")) < 1e-9).alias("as_recomputed"))


@query(
    "builtin_importance",
    _vec("SELECT 64::BIGINT AS features, true AS share_of_one, true AS falling, true AS unused_have_none FROM (SELECT count(*) FROM vectors)"),
)
def _(spark, d):
    """One share per feature, the largest first; none for a feature that no tree splits on."""
    v = vectors(spark, d)
    model = models.train_classifier(v, "gbt", max_iter=3)
    rows = importance.builtin_importance(model, [f"f{i}" for i in range(64)], v).collect()
    values = [x["importance"] for x in rows]
    used = {f"f{i}" for tree in model.trees for i in map(int, re.findall(r"feature (\d+)", tree.toDebugString))}
    checks = (len(rows), abs(sum(values) - 1) < 1e-9, values == sorted(values, reverse=True), all(x["importance"] == 0 for x in rows if x["feature"] not in used))
    return spark.createDataFrame([checks], "features long, share_of_one boolean, falling boolean, unused_have_none boolean")


# ---- monitoring ------------------------------------------------------------------------

_TESTED = ["amount", "velocity_score", "geo_anomaly_score", "spending_deviation_score"]
_CUT = "TIMESTAMP '2024-01-16'"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tx, cut = transactions(spark, d), F.lit("2024-01-16").cast("timestamp")
    return tx.filter(F.col("timestamp") < cut), tx.filter(F.col("timestamp") >= cut)


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, timestamp >= {_CUT} AS new FROM tx WHERE {c} IS NOT NULL" for c in _TESTED)
_KS = f""", l AS ({_LONG}), g AS (SELECT feature, value, count(*) FILTER (NOT new) AS a, count(*) FILTER (new) AS b FROM l GROUP BY 1, 2),
  f AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb
    FROM g WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
  d AS (SELECT feature, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS ks, max(na)::DOUBLE AS n1, max(nb)::DOUBLE AS n2 FROM f GROUP BY 1),
  lam AS (SELECT feature, ks, ks * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM d),
  kp AS (SELECT feature, ks, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101),
    lambda j: (CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * j * j * lam * lam))), 0), 1) END AS p FROM lam)"""


def _drift(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return monitor.ks_drift(old, new, [*_TESTED, "merchant_category"], method="asymptotic")


@query("ks_drift", _tx(f"{_KS} SELECT feature, {R('ks')} AS ks_statistic, {R('p')} AS p_value, p < 0.05 AS drift_detected FROM kp"))
def _(spark, d):
    return rounded(_drift(spark, d), "ks_statistic", "p_value")


_LED = ["amount", "quantity", "discount", "tax"]
_LED_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, is_fraud AS new FROM ledger" for c in _LED)


@query(
    "ks_drift_ledger",
    f"WITH {LEDGER_SQL}" + _KS.replace(f"l AS ({_LONG})", f"l AS ({_LED_LONG})") + f" SELECT feature, {R('ks')} AS ks_statistic, {R('p')} AS p_value, p < 0.05 AS drift_detected FROM kp",
)
def _(spark, d):
    rows = ledger(spark, d)
    return rounded(monitor.ks_drift(rows.filter("NOT is_fraud"), rows.filter("is_fraud"), _LED, method="asymptotic"), "ks_statistic", "p_value")


_SUMMARY = """sm AS (SELECT count(*) AS tested, count(*) FILTER (p < 0.05) AS drifted, avg((p < 0.05)::INTEGER) AS share,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (p < 0.05), '') AS names FROM kp)"""


@query("drift_summary", _tx(f"{_KS}, {_SUMMARY} SELECT tested, drifted, {R('share')} AS drift_share, names AS drifted_features, 0.05::DOUBLE AS drift_threshold FROM sm"))
def _(spark, d):
    return rounded(monitor.drift_summary(_drift(spark, d)), "drift_share")


# Means per category before and after the cut: two small samples, whose p is exact. The lattice walk is the same in SQL.
_EXACT_SQL = f"""WITH RECURSIVE {TX_SQL},
  v AS (SELECT merchant_category, timestamp >= {_CUT} AS new, avg(amount) AS value FROM tx GROUP BY ALL),
  n AS (SELECT count(*) FILTER (NOT new) AS m, count(*) FILTER (new) AS n FROM v),
  k AS (SELECT max(abs((SELECT count(*) FROM v a WHERE NOT a.new AND a.value <= v.value) / m::DOUBLE - (SELECT count(*) FROM v b WHERE b.new AND b.value <= v.value) / n::DOUBLE)) AS d FROM v, n),
  walk(step, i, c) AS (
    SELECT 0::BIGINT, 0::BIGINT, 1.0::DOUBLE
    UNION ALL
    SELECT step, i, sum(c) FROM (
      SELECT w.step + 1 AS step, w.i + g.add AS i,
        w.c * CASE WHEN g.add = 1 THEN m - w.i ELSE n - (w.step - w.i) END / (m + n - w.step)::DOUBLE AS c
      FROM walk w, n, (VALUES (0), (1)) g(add) WHERE w.step < m + n
    ) s, n, k WHERE i <= m AND step - i <= n AND abs(i / m::DOUBLE - (step - i) / n::DOUBLE) < d - 1e-9 GROUP BY step, i
  )
  SELECT 'value' AS feature, {R('d')} AS ks_statistic, {R('1 - coalesce((SELECT c FROM walk, n WHERE step = m + n), 0)')} AS p_value,
    1 - coalesce((SELECT c FROM walk, n WHERE step = m + n), 0) < 0.05 AS drift_detected FROM k"""


@query("ks_drift_exact", _EXACT_SQL)
def _(spark, d):
    old, new = (half.groupBy("merchant_category").agg(F.avg("amount").alias("value")) for half in _halves(spark, d))
    return rounded(monitor.ks_drift(old, new, ["value"]), "ks_statistic", "p_value")


def _drift_hist_sql() -> str:
    # The first half's amounts against the second half's doubled amounts: a drift that is really there.
    return f"""WITH {TX_SQL}, v AS (SELECT CASE WHEN timestamp < {_CUT} THEN 'reference' ELSE 'production' END AS source,
        CASE WHEN timestamp < {_CUT} THEN amount ELSE amount * 2 END AS v FROM tx), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
      SELECT source, least(floor((v - lo) * 50 / (hi - lo)), 49)::INTEGER AS bucket, count(*) AS n,
        {R('min(lo + least(floor((v - lo) * 50 / (hi - lo)), 49) * (hi - lo) / 50)')} AS lower, 'amount' AS feature FROM v, b GROUP BY 1, 2"""


@query("drift_histograms", _drift_hist_sql())
def _(spark, d):
    old, new = _halves(spark, d)
    new = new.withColumn("amount", F.col("amount") * 2)
    drift = monitor.ks_drift(old, new, ["amount"], method="asymptotic")
    return rounded(monitor.drift_histograms(old, new, drift), "lower")


_PERF = f""", g AS (SELECT timestamp >= {_CUT} AS new, label, probability >= 0.5 AS g FROM scored),
  a AS (SELECT {_CM} FROM g WHERE NOT new), b AS (SELECT {_CM} FROM g WHERE new),
  pf AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, (SELECT {_metric(m)} FROM a) AS reference, (SELECT {_metric(m)} FROM b) AS production" for m in _METRICS)})"""


def _performance(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp")
    sourced = scored(spark, d).withColumn("source", F.when(F.col("timestamp") < cut, "reference").otherwise("production"))
    return monitor.monitor_performance(sourced, "source", "label", "probability")


@query(
    "monitor_performance",
    _sc(f"{_PERF} SELECT metric, reference, production, {R('production - reference', 5)} AS difference, NULL::VARCHAR AS note FROM pf"),
)
def _(spark, d):
    return rounded(rounded(_performance(spark, d), "reference", "production"), "difference", digits=5)


@query(
    "recommendations",
    _sc(
        f"""{_KS}, {_SUMMARY}{_PERF}, df AS (SELECT production - reference AS df FROM pf WHERE metric = 'accuracy'),
        fi AS (SELECT unnest([CASE WHEN 100 * share > 50 THEN 'high_drift' WHEN 100 * share > 20 THEN 'moderate_drift' ELSE 'low_drift' END,
          CASE WHEN df < -0.1 THEN 'performance_degradation' END, CASE WHEN df > 0.1 THEN 'unexpected_improvement' END]) AS finding FROM sm, df)
        SELECT finding, CASE finding WHEN 'high_drift' THEN 'retrain on recent data' WHEN 'moderate_drift' THEN 'watch model performance closely'
          WHEN 'low_drift' THEN 'nothing to do' WHEN 'performance_degradation' THEN 'check feature importance and retrain'
          ELSE 'check for leaked labels or sampling bias' END AS advice FROM fi WHERE finding IS NOT NULL""".replace(", g AS (SELECT timestamp", ", g2 AS (SELECT timestamp").replace("FROM g WHERE", "FROM g2 WHERE")
    ),
)
def _(spark, d):
    return monitor.recommendations(monitor.drift_summary(_drift(spark, d)), _performance(spark, d))


@query(
    "monitoring_report",
    _sc(
        f"""{_KS}{_PERF}
        SELECT 'performance_reference' AS section, metric AS name, {R('reference', 5)} AS value FROM pf
        UNION ALL SELECT 'performance_production', metric, {R('production', 5)} FROM pf
        UNION ALL SELECT 'performance_difference', metric, {R('production - reference', 5)} FROM pf
        UNION ALL SELECT 'drift_statistic', feature, {R('ks', 5)} FROM kp UNION ALL SELECT 'drift_p_value', feature, {R('p', 5)} FROM kp
        UNION ALL SELECT 'recommendation', CASE WHEN avg((p < 0.05)::INTEGER) > 0.5 THEN 'high_drift' WHEN avg((p < 0.05)::INTEGER) > 0.2 THEN 'moderate_drift' ELSE 'low_drift' END, 1.0::DOUBLE FROM kp""".replace(", g AS (SELECT timestamp", ", g2 AS (SELECT timestamp").replace("FROM g WHERE", "FROM g2 WHERE")
    ),
)
def _(spark, d):
    drift, performance = _drift(spark, d), _performance(spark, d)
    advice = monitor.recommendations(monitor.drift_summary(drift))
    return rounded(monitor.monitoring_report(drift, performance, advice), "value", digits=5)


# ---- streaming -------------------------------------------------------------------------

_RECORD = ["transaction_id", "timestamp", "amount", "sender_account", "receiver_account", "merchant_category"]


def _json_folder(spark: SparkSession, d: str) -> str:
    """The transactions as JSON record files in the shared folder."""
    path = scratch_path(spark, "records")
    transactions(spark, d).select(*_RECORD).write.json(path)
    return path


_RECORD_SQL = "transaction_id::VARCHAR AS transaction_id, amount, sender_account::VARCHAR AS sender_account, merchant_category"


@query("stream_files", _tx(f"SELECT {_RECORD_SQL}, epoch_us(timestamp) // 1000 AS ms FROM tx"))
def _(spark, d):
    stream = stream_sources.stream_files(spark, _json_folder(spark, d))
    out = scratch_path(spark, "stream-out")
    job = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp"))
        .trigger(**stream_scoring.trigger_options(once=True)).start()
    )
    job.awaitTermination()
    back = spark.read.parquet(out)
    return back.select("transaction_id", "amount", "sender_account", "merchant_category", F.unix_millis("timestamp").alias("ms"))


@query(
    "parse_json",
    _tx("SELECT CASE WHEN transaction_id % 11 <> 0 THEN transaction_id::VARCHAR END AS transaction_id, CASE WHEN transaction_id % 11 <> 0 THEN amount END AS amount FROM tx"),
)
def _(spark, d):
    tx = transactions(spark, d)
    text = F.to_json(F.struct(F.col("transaction_id").cast("string").alias("transaction_id"), "amount"))
    lines = tx.select(F.when(F.col("transaction_id") % 11 == 0, F.concat(F.lit("broken "), text)).otherwise(text).alias("value"))
    return stream_sources.parse_json(lines).select("transaction_id", "amount")


@query("parse_json_rejects", _tx("SELECT count(*) FILTER (transaction_id % 11 = 0) AS rejected, count(*) FILTER (transaction_id % 11 <> 0) AS usable FROM tx"))
def _(spark, d):
    tx = transactions(spark, d)
    text = F.to_json(F.struct(F.col("transaction_id").cast("string").alias("transaction_id"), "amount"))
    parsed = stream_sources.parse_json(tx.select(F.when(F.col("transaction_id") % 11 == 0, F.lit("broken")).otherwise(text).alias("value")))
    good, bad = stream_sources.split_rejects(parsed)
    return bad.select(F.lit(1).alias("b"), F.lit(0).alias("g")).unionByName(good.select(F.lit(0).alias("b"), F.lit(1).alias("g"))).agg(
        F.sum("b").alias("rejected"), F.sum("g").alias("usable")
    )


# A stated linear classifier and a one-axis reconstructor over four features, prepared by what the transactions say.
_SET_FEATURES = ("amount", "amount_log", "velocity_score_norm", "transaction_frequency")
_SET_WEIGHTS, _SET_BIAS, _SET_AXIS, _SET_CUTS = (0.9, -0.4, 0.3, 0.2), -0.7, (0.5, 0.5, 0.5, 0.5), (0.35, 0.8)
_SET_SQL = f"""
  seen AS (SELECT amount, CASE WHEN amount > -1 THEN ln(1 + amount) END AS amount_log, velocity_score / 100.0::DOUBLE AS velocity_score_norm,
    CASE WHEN time_since_last_transaction > 0 THEN 86400.0::DOUBLE / time_since_last_transaction ELSE 1.0::DOUBLE END AS transaction_frequency FROM tx),
  fills AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _SET_FEATURES)} FROM seen),
  filled AS (SELECT {', '.join(f'coalesce(s.{c}, f.{c}) AS {c}' for c in _SET_FEATURES)} FROM seen s, fills f),
  moments AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(_SET_FEATURES))} FROM filled),
  x AS (SELECT tx.*, [(coalesce(tx.amount, f.amount) - m0) / s0, (coalesce(ln(1 + tx.amount), f.amount_log) - m1) / s1,
    (0.0::DOUBLE - m2) / s2, (1.0::DOUBLE - m3) / s3] AS x FROM tx, fills f, moments),
  y AS (SELECT *, 1.0::DOUBLE / (1.0 + exp(-({_SET_BIAS}::DOUBLE + {' + '.join(f'{w}::DOUBLE * x[{i + 1}]' for i, w in enumerate(_SET_WEIGHTS))}))) AS p,
    ({' + '.join(f'{w}::DOUBLE * x[{i + 1}]' for i, w in enumerate(_SET_AXIS))}) AS z FROM x),
  stated AS (SELECT *, list_sum(list_transform(x, lambda v, i: (v - z * ({list(_SET_AXIS)}::DOUBLE[])[i]) * (v - z * ({list(_SET_AXIS)}::DOUBLE[])[i]))) / 4 AS e FROM y)"""


def _seen(spark: SparkSession, d: str) -> DataFrame:
    tx = transactions(spark, d)
    return tx.select(
        "transaction_id", F.col("is_fraud").cast("int").alias("fraud_label"), "amount", scalar.amount_log(F.col("amount")).alias("amount_log"),
        scalar.velocity_score_norm(F.col("velocity_score")).alias("velocity_score_norm"),
        scalar.default_tx_frequency(F.col("time_since_last_transaction")).alias("transaction_frequency"),
    )


def _stated_set(spark: SparkSession, d: str) -> str:
    """Where the set with the stated models was saved."""
    seen, names = _seen(spark, d), list(_SET_FEATURES)
    medians = clean.column_quantiles(seen, names, [0.5])
    filled = seen.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0])) for c in names})
    prepared = scoring_set.preparation(seen, names, medians, prep.fit_scaler(filled, names))
    axes = np.array(_SET_AXIS).reshape(-1, 1)
    rebuilt = models.Reconstructor(np.zeros(4), np.ones(4), axes)
    stated = replace(
        prepared, classifier=scoring_set.Linear(_SET_WEIGHTS, _SET_BIAS), reconstructor=rebuilt,
        probability_cut=_SET_CUTS[0], anomaly_cut=_SET_CUTS[1],
    )
    path = scratch_path(spark, "scoring-set")
    stated.save(spark, path)
    return path


_STREAM_OUT = ["transaction_id", "fraud_probability", "anomaly_score", *_FLAGS, "is_fraud_ensemble", "merchant_category"]


@query(
    "score_stream",
    _tx(
        f""", {_SET_SQL} SELECT transaction_id::VARCHAR AS transaction_id, {R('p')} AS fraud_probability, {R('e')} AS anomaly_score,
        p >= {_SET_CUTS[0]} AS is_fraud_classification, e >= {_SET_CUTS[1]} AS is_fraud_anomaly,
        p >= {_SET_CUTS[0]} OR e >= {_SET_CUTS[1]} AS is_fraud_ensemble, merchant_category FROM stated"""
    ),
)
def _(spark, d):
    """A saved set (alignment, fills, scales, both models, both cuts) over a stream of records."""
    stream = stream_sources.stream_files(spark, _json_folder(spark, d))
    out = scratch_path(spark, "scored")
    stream_scoring.score_stream_with(stream, _stated_set(spark, d), stream_scoring.sink_files(out), once=True).awaitTermination()
    return rounded(spark.read.parquet(out).select(*_STREAM_OUT), "fraud_probability", "anomaly_score")


@query(
    "score_stream_restarted",
    _tx(
        """SELECT transaction_id::VARCHAR AS transaction_id, 1::BIGINT AS times_scored, true AS as_in_batch, true AS as_from_coefficients
        FROM tx"""
    ),
)
def _(spark, d):
    """Fitted models, saved; half of the records, a restart with the set read again, the rest; against one batch.

    ``as_from_coefficients`` recomputes the probability from the numbers in the saved table.
    """
    done = pipeline.training_job(_seen(spark, d), features=_SET_FEATURES, anomaly_axes=2)
    path, source, out, checkpoint = (scratch_path(spark, n) for n in ("scoring-set", "records", "scored", "cp"))
    done.scoring.save(spark, path)
    rows = transactions(spark, d).select(*_RECORD)
    for half in (0, 1):
        rows.filter(F.col("transaction_id") % 2 == half).write.mode("append").json(source)
        stream = stream_sources.stream_files(spark, source, files_per_trigger=3)
        stream_scoring.score_stream_with(stream, path, stream_scoring.sink_files(out), checkpoint, once=True).awaitTermination()
    streamed = spark.read.parquet(out)
    saved = spark.read.parquet(f"{path}/set").select("center", "scale", "weights", "bias").first().asDict()
    records = spark.read.schema(stream_sources.STREAM_RECORD).json(source)
    batch = scoring_set.ScoringSet.load(spark, path).score(records).select(
        "transaction_id", F.col("fraud_probability").alias("p"), F.col("anomaly_score").alias("e")
    )
    columns = "array(amount, ln(1 + amount), 0D, 1D)"
    logit = f"bias + aggregate(zip_with(zip_with(zip_with({columns}, center, (v, c) -> v - c), scale, (v, s) -> v / s), weights, (v, w) -> v * w), 0D, (a, v) -> a + v)"
    numbers = {c: F.lit(v) for c, v in saved.items()}
    plain = records.withColumns(numbers).selectExpr("transaction_id", f"1 / (1 + exp(-({logit}))) AS q")
    times = streamed.groupBy("transaction_id").agg(
        F.count("*").alias("times_scored"), F.max("fraud_probability").alias("fp"), F.max("anomaly_score").alias("es")
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    return times.join(batch, "transaction_id").join(plain, "transaction_id").select(
        "transaction_id", "times_scored", (near("fp", "p") & near("es", "e")).alias("as_in_batch"), near("fp", "q").alias("as_from_coefficients")
    )


def _stream_scorer(batch: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return batch.withColumns({"fraud_probability": amount / (amount + 50.0), "anomaly_score": amount * amount / 1000.0})


def _drain(spark: SparkSession, source: str, out: str, checkpoint: str, fmt: str) -> None:
    stream = stream_sources.stream_files(spark, source, files_per_trigger=100)
    sink = stream_scoring.sink_files(out, fmt)
    stream_scoring.score_stream(stream, _stream_scorer, sink, checkpoint, once=True, anomaly_cut=10.0).awaitTermination()


@query("sink_files", _sc(f", {_FLAGS_SQL} SELECT transaction_id::VARCHAR AS transaction_id, is_fraud_ensemble FROM flagged"))
def _(spark, d):
    out = scratch_path(spark, "scored-json")
    _drain(spark, _json_folder(spark, d), out, scratch_path(spark, "cp"), "json")
    return spark.read.schema("transaction_id string, is_fraud_ensemble boolean").json(f"{out}/epoch=*")


@query("trigger_and_checkpoint", _sc(f", {_FLAGS_SQL} SELECT count(*) AS rows, count(*) FILTER (is_fraud_ensemble) AS fraud_rows FROM flagged"))
def _(spark, d):
    """Half of the files, a restart from the checkpoint with the other half: nothing lost or doubled."""
    source, out, checkpoint = scratch_path(spark, "records"), scratch_path(spark, "scored"), scratch_path(spark, "cp")
    rows = transactions(spark, d).select(*_RECORD)
    for half in (0, 1):
        rows.filter(F.col("transaction_id") % 2 == half).write.mode("append").json(source)
        _drain(spark, source, out, checkpoint, "parquet")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_fraud_ensemble").alias("fraud_rows"))


@query("stream_history_features", queries_features.history_sql(list(HISTORY_COLUMNS), "tx"))
def _(spark, d):
    """The records in three batches by time, the state carried over two restarts."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("records", "history", "cp"))
    rows = transactions(spark, d).select(*_RECORD)
    found = rows.select(F.percentile_approx(F.unix_micros("timestamp"), [0.33, 0.66]).alias("at"), F.count(F.lit(1)).alias("n")).first()
    cuts = [0, *(int(c) for c in found["at"]), 2**62]
    states = stream_history.STATE_STORE | {"spark.sql.shuffle.partitions": stream_history.state_partitions(found["n"])}
    for low, high in zip(cuts, cuts[1:]):
        at = F.unix_micros("timestamp")
        part = rows.filter((at >= low) & (at < high)).withColumn("transaction_id", F.lpad(F.col("transaction_id").cast("string"), 20, "0"))
        # Microseconds survive the JSON round trip only if asked for.
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)
        # All files of a third go into one batch: cut by files, its rows would not come in the order of their time.
        n_files = len(spark.read.schema(stream_sources.STREAM_RECORD).json(source).inputFiles())
        stream = stream_sources.stream_files(spark, source, files_per_trigger=max(100, n_files))
        with settings(spark, states):
            job = stream_history.stream_history_features(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            job.trigger(**stream_scoring.trigger_options(once=True)).start().awaitTermination()
    back = spark.read.parquet(out).withColumn("transaction_id", F.col("transaction_id").cast("long"))
    return rounded(back.select("transaction_id", *HISTORY_COLUMNS), *HISTORY_COLUMNS)


@query(
    "sink_kafka_payload",
    _sc("SELECT transaction_id::VARCHAR AS key, merchant_category FROM scored"),
)
def _(spark, d):
    payload = stream_scoring.kafka_payload(_flagged(spark, d))
    return payload.select("key", F.get_json_object("value", "$.merchant_category").alias("merchant_category"))
