"""Training with Spark ML: the roles of a fraud classifier and of an anomaly reconstructor."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.random import det_rand
from txrisk.operators.evaluation import LOSSES, roc_auc
from txrisk.operators.explore import class_weights
from txrisk.session import ensure_checkpoint_dir

Loss = Callable[..., Column]


def as_vectors(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Arrays to ML vectors, label to double."""
    kind = df.schema[features].dataType
    vector = array_to_vector(F.col(features).cast("array<double>")) if isinstance(kind, T.ArrayType) else F.col(features)
    return df.withColumns({features: vector, label: F.col(label).cast("double")})


def train_classifier(
    df: DataFrame,
    kind: str = "mlp",
    hidden: Sequence[int] = (16, 8),
    weight: str | None = None,
    l2: float = 0.0,
    max_iter: int = 50,
    seed: int = 42,
    validation: str | None = None,
    features: str = "features",
    label: str = "label",
) -> Model:
    """A probability model: ``mlp``, ``logistic`` or ``gbt``.

    The perceptron has no row weights and no L2; asking for them is an error rather than ignored.
    """
    data = as_vectors(df, features, label)
    common = {"featuresCol": features, "labelCol": label}
    if kind == "mlp":
        if weight or l2:
            raise ValueError("the perceptron supports neither weights nor L2; use logistic or gbt")
        width = int(data.select(F.size(vector_to_array(features))).first()[0])
        estimator = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=max_iter, seed=seed, **common)
    elif kind == "logistic":
        estimator = LogisticRegression(maxIter=max_iter, regParam=l2, **common)
    elif kind == "gbt":
        estimator = GBTClassifier(maxIter=max_iter, seed=seed, **common)
        if validation:
            estimator.setValidationIndicatorCol(validation)
    else:
        raise ValueError(f"unknown classifier: {kind}")
    if weight:
        estimator.setWeightCol(weight)
    return estimator.fit(data)


def with_class_weights(df: DataFrame, label: str = "label", ratio: float | None = None) -> DataFrame:
    """Add ``weight``: total / (classes * count of the row's class), or 1 and, for label 1, ``ratio``.

    Rows without a label can't be learned from and are left out.
    """
    known = df.filter(F.col(label).isNotNull())
    if ratio is not None:
        return known.withColumn("weight", F.when(F.col(label).cast("int") == 1, float(ratio)).otherwise(1.0))
    table = class_weights(known, label).select(F.col(label).alias("_class"), "weight")
    return known.join(table, F.col(label) == F.col("_class")).drop("_class")


def train_weighted(df: DataFrame, kind: str = "logistic", label: str = "label", ratio: float | None = None, **options) -> Model:
    return train_classifier(with_class_weights(df, label, ratio), kind, weight="weight", label=label, **options)


@dataclass(frozen=True)
class LinearLogistic:
    """A logistic model found by ``train_loss``; scores like a fitted Spark ML classifier."""

    coefficients: DenseVector
    intercept: float
    #: Mean loss (with the penalty) after every step, the first one before any.
    history: tuple[float, ...]
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self.features].dataType
        x = F.col(self.features) if isinstance(kind, T.ArrayType) else vector_to_array(self.features)
        p = _sigmoid(_dot(x, self.coefficients.toArray(), self.intercept))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def _dot(x: Column, weights: Sequence[float], start: float = 0.0) -> Column:
    both = F.zip_with(x, F.lit([float(w) for w in weights]), lambda a, w: a * w)
    return F.aggregate(both, F.lit(float(start)), lambda a, v: a + v)


def _times(column: str) -> Callable[[Column], Column]:
    return lambda x: x * F.col(column)


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: Half the width of the difference quotient of a loss by its logit.
_NUDGE = 1e-4
#: Step lengths tried together in one pass over the rows.
_STEPS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def _two_loops(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction from the last moves and their changes of the gradient (L-BFGS)."""
    q, shares = gradient.copy(), []
    for s, y in reversed(moves):
        share = (s @ q) / (y @ s)
        shares.append(share)
        q -= share * y
    if moves:
        s, y = moves[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), share in zip(moves, reversed(shares)):
        q += s * (share - (y @ q) / (y @ s))
    return -q


def train_loss(
    df: DataFrame, loss: str | Loss = "focal", l2: float = 0.01, max_iter: int = 30, tolerance: float = 1e-7, features: str = "features",
    label: str = "label", **parameters,
) -> LinearLogistic:
    """The linear model with the least mean ``loss(label, probability)``, for any loss written as a column.

    ``loss`` is a name of ``evaluation.LOSSES`` or a function of two columns; ``parameters`` go to it. Every step is two
    passes over the stored rows: one sums the gradient, a weighted sum of feature vectors, the other tries several
    step lengths at once. Only numbers per feature reach the driver. Features are scaled inside, and ``l2`` counts in
    that scale. Rows without a label are left out.
    """
    chosen = LOSSES[loss] if isinstance(loss, str) else loss
    ensure_checkpoint_dir(df.sparkSession)
    data = as_vectors(df.filter(F.col(label).isNotNull()), features, label).select(F.col(label).alias("y"), F.col(features).alias("v"))
    moments = data.select(Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("m")).first()["m"]
    mean, spread, rows = moments["mean"].toArray(), moments["std"].toArray(), moments["count"]
    if not rows:
        raise ValueError("no labelled rows to train on")
    spread = np.where(spread > 0, spread, 1.0)
    scaler = F.zip_with(F.zip_with(vector_to_array("v"), F.lit(mean.tolist()), lambda a, m: a - m), F.lit(spread.tolist()), lambda a, s: a / s)
    data = data.select("y", scaler.alias("x")).withColumn("v", array_to_vector("x")).checkpoint()

    def total(z: Column) -> Column:
        return chosen(F.col("y"), _sigmoid(z), **parameters)

    def slope(at: np.ndarray) -> tuple[float, np.ndarray]:
        z = _dot(F.col("x"), at[1:], at[0])
        g = (total(z + _NUDGE) - total(z - _NUDGE)) / (2 * _NUDGE)
        marked = data.select("v", g.alias("g"), total(z).alias("l"))
        # The summarizer takes weights of one sign.
        parts = [Summarizer.metrics("sum").summary(F.col("v"), F.greatest(F.col("g") * sign, F.lit(0.0))).alias(n) for n, sign in (("up", 1), ("down", -1))]
        r = marked.agg(*parts, F.sum("g").alias("g"), F.avg("l").alias("l")).first()
        by_feature = (r["up"]["sum"].toArray() - r["down"]["sum"].toArray()) / rows
        return r["l"] + l2 / 2 * float(at[1:] @ at[1:]), np.append(r["g"] / rows, by_feature + l2 * at[1:])

    def along(at: np.ndarray, way: np.ndarray) -> list[float]:
        z, dz = _dot(F.col("x"), at[1:], at[0]), _dot(F.col("x"), way[1:], way[0])
        row = data.select(z.alias("z"), dz.alias("dz"), "y").agg(*[F.avg(total(F.col("z") + t * F.col("dz"))) for t in _STEPS]).first()
        return [value + l2 / 2 * float((at + t * way)[1:] @ (at + t * way)[1:]) for value, t in zip(row, _STEPS)]

    at = np.zeros(1 + len(mean))
    now, gradient = slope(at)
    history, moves = [now], []
    for _ in range(max_iter):
        if np.abs(gradient).max() < tolerance:
            break
        way = _two_loops(gradient, moves)
        if way @ gradient >= 0:
            moves, way = [], -gradient
        found = along(at, way)
        best = int(np.argmin(found))
        if not found[best] < now:
            if not moves:
                break
            moves = []
            continue
        move = _STEPS[best] * way
        at = at + move
        now, after = slope(at)
        if move @ (after - gradient) > 1e-12:
            moves = [*moves, (move, after - gradient)][-10:]
        gradient = after
        history.append(now)
    weights = at[1:] / spread
    return LinearLogistic(DenseVector(weights), float(at[0] - weights @ mean), tuple(history), features)


def train_focal(
    df: DataFrame, gamma: float = 2.0, alpha: float = 0.25, l2: float = 0.01, features: str = "features", label: str = "label", max_iter: int = 30,
) -> LinearLogistic:
    return train_loss(df, "focal", l2, max_iter, features=features, label=label, gamma=gamma, alpha=alpha)


@dataclass(frozen=True)
class Tuned:
    """``points`` (point, parameters, auc), the best point's model refitted on everything, and the validation scores."""

    best: dict
    model: Model
    points: DataFrame
    scores: DataFrame


def tune_classifier(
    df: DataFrame, grid: dict[str, Sequence] | None = None, val_share: float = 0.25, salt: int = 42, parallelism: int = 4,
    row_id: str = "id", features: str = "features", label: str = "label", max_iter: int = 20,
) -> Tuned:
    """Grid search over perceptrons by validation AUC; ties go to the earlier point.

    Validation rows are picked by a hash of their id, so the split doesn't depend on partitions. Points are fitted side
    by side on one stored table. Gradient descent, not l-bfgs, is the solver, so that ``stepSize`` counts.
    ``hidden`` in the grid lists the inner layers.
    """
    ensure_checkpoint_dir(df.sparkSession)
    data = as_vectors(df.select(row_id, features, label).filter(F.col(label).isNotNull()), features, label)
    data = data.withColumn("_val", det_rand(F.col(row_id), salt) < val_share).checkpoint()
    train, val = data.filter(~F.col("_val")), data.filter("_val")
    width = int(data.select(F.size(vector_to_array(features))).first()[0])
    choices = grid or {"hidden": [[8], [16, 8]], "stepSize": [0.01, 0.03]}
    points = [dict(zip(choices, values)) for values in itertools.product(*choices.values())]

    def fit(rows: DataFrame, point: dict) -> Model:
        rest = {k: v for k, v in point.items() if k != "hidden"}
        layers = [width, *point.get("hidden", [8]), 2]
        estimator = MultilayerPerceptronClassifier(
            layers=layers, solver="gd", maxIter=rest.pop("maxIter", max_iter), seed=salt, featuresCol=features, labelCol=label, **rest
        )
        return estimator.fit(rows)

    with ThreadPool(min(parallelism, len(points))) as pool:
        fitted = pool.map(lambda point: fit(train, point), points)
    scored = [
        model.transform(val).select(F.lit(i).alias("point"), row_id, F.col(label).cast("int").alias(label), vector_to_array("probability")[1].alias("score"))
        for i, model in enumerate(fitted)
    ]
    scores = reduce(DataFrame.unionByName, scored).checkpoint()
    auc = {r["point"]: r["auc"] for r in roc_auc(scores, "score", label, ["point"]).collect()}
    rows = [(i, json.dumps(p, sort_keys=True), float(auc.get(i, 0.0))) for i, p in enumerate(points)]
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    table = df.sparkSession.createDataFrame(rows, "point int, parameters string, auc double")
    return Tuned(points[best], fit(data, points[best]), table, scores)


@dataclass(frozen=True)
class Reconstructor:
    """Standardise, project on the leading components, project back.

    The optimal linear auto-encoder under squared error. ``mean``, ``scale`` (d) and ``axes``
    (d x k) are all it takes, so scoring is one Arrow-batched matrix product per batch.
    """

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    def with_error(self, df: DataFrame, features: str = "features", output: str = "anomaly_score") -> DataFrame:
        """Add the mean squared error of the reconstruction: column expressions only, for streams and wide scans."""
        scaled = F.zip_with(F.col(features).cast("array<double>"), F.lit(self.mean.tolist()), lambda x, m: x - m)
        scaled = F.zip_with(scaled, F.lit(self.scale.tolist()), lambda x, s: x / s)
        axes = [a.tolist() for a in self.axes.T]
        out = df.withColumn("_z", scaled).withColumns({f"_p{k}": _dot(F.col("_z"), a) for k, a in enumerate(axes)})
        left = F.col("_z")
        for k, a in enumerate(axes):
            left = F.zip_with(left, F.transform(F.lit(a), _times(f"_p{k}")), lambda x, y: x - y)
        square = F.aggregate(F.transform(left, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
        return out.withColumn(output, square / F.lit(float(max(len(self.mean), 1)))).drop("_z", *[f"_p{k}" for k in range(len(axes))])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``scaled`` and ``rebuilt`` arrays."""
        mean, scale, axes = self.mean, self.scale, self.axes

        @F.pandas_udf("scaled array<double>, rebuilt array<double>")
        def rebuild(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for x in batches:
                z = (np.array(x.tolist(), dtype="float64").reshape(len(x), len(mean)) - mean) / scale
                yield pd.DataFrame({"scaled": list(z), "rebuilt": list((z @ axes) @ axes.T)})

        both = df.withColumn("_both", rebuild(F.col(features).cast("array<double>")))
        return both.select(*df.columns, "_both.scaled", "_both.rebuilt")


def train_reconstructor(
    df: DataFrame, encoding_dim: int = 8, features: str = "features", label: str = "label"
) -> Reconstructor:
    """Fit on the normal rows only."""
    normal = as_vectors(df.filter(F.col(label).cast("int") == 0), features, label)
    scaler = StandardScaler(inputCol=features, outputCol="_z", withMean=True, withStd=True).fit(normal)
    pca = PCA(k=encoding_dim, inputCol="_z", outputCol="_p").fit(scaler.transform(normal))
    scale = scaler.std.toArray()
    return Reconstructor(scaler.mean.toArray(), np.where(scale == 0, 1.0, scale), pca.pc.toArray())
