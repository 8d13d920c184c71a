"""Everything a scorer needs, fitted once, saved and read back: features, fills, scales, both models, both cuts.

The numbers are one row of a table; a classifier that is not linear is saved beside it by Spark ML's own writer. A
linear classifier is an expression, so that scoring it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scalar import null_if_nan
from txrisk.functions.vectors import linear_score
from txrisk.operators.align import feature_values
from txrisk.operators.models import Reconstructor
from txrisk.operators.scoring import DEFAULT_ANOMALY_CUT, DEFAULT_PROBABILITY_CUT, score_probability

_SCHEMA = (
    "features array<string>, fill array<double>, center array<double>, scale array<double>, weights array<double>, bias double, "
    "mean array<double>, spread array<double>, axes array<array<double>>, probability_cut double, anomaly_cut double, has_model boolean"
)


@dataclass(frozen=True)
class Linear:
    """A logistic model over the prepared features."""

    weights: tuple[float, ...]
    bias: float


@dataclass(frozen=True)
class ScoringSet:
    """``classifier`` is linear, any Spark ML model with a probability, or None; ``reconstructor`` may be None."""

    features: tuple[str, ...]
    fill: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    classifier: Linear | Model | None = None
    reconstructor: Reconstructor | None = None
    probability_cut: float = DEFAULT_PROBABILITY_CUT
    anomaly_cut: float = DEFAULT_ANOMALY_CUT

    def prepare(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature array: in the saved order, missing columns derived or 0, gaps filled, scaled."""
        values = feature_values(df, self.features)
        cells = [
            (F.coalesce(null_if_nan(v), F.lit(float(f))) - F.lit(float(c))) / F.lit(float(s))
            for v, f, c, s in zip(values, self.fill, self.center, self.scale)
        ]
        return df.withColumn(output, F.array(*cells) if cells else F.lit(None).cast("array<double>"))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``fraud_probability`` and ``anomaly_score``, of those models that are there."""
        kept, x = df.columns, "_features"
        out = self.prepare(df, x)
        if isinstance(self.classifier, Linear):
            columns = [F.get(x, F.lit(i)) for i in range(len(self.features))]
            out = out.withColumn("fraud_probability", linear_score(columns, list(self.classifier.weights), self.classifier.bias))
        elif self.classifier is not None:
            name = self.classifier.getFeaturesCol()
            renamed = out.withColumn(name, array_to_vector(x)) if name not in kept else out
            if renamed is out:
                raise ValueError(f"the table's own column {name} hides the model's features")
            out = score_probability(renamed, self.classifier).drop(name)
        if self.reconstructor is not None:
            out = self.reconstructor.with_error(out, x)
        scores = [c for c in ("fraud_probability", "anomaly_score") if c in out.columns and c not in kept]
        return out.select(*kept, *scores)

    def save(self, spark: SparkSession, path: str) -> None:
        linear = self.classifier if isinstance(self.classifier, Linear) else None
        model = self.classifier if linear is None else None
        r = self.reconstructor
        row = (
            list(self.features), list(self.fill), list(self.center), list(self.scale),
            list(linear.weights) if linear else None, linear.bias if linear else None,
            r.mean.tolist() if r else None, r.scale.tolist() if r else None, r.axes.tolist() if r else None,
            self.probability_cut, self.anomaly_cut, model is not None,
        )
        if model is not None:
            model.write().overwrite().save(f"{path}/classifier")
        # Written last: a set without its row is not there.
        spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/set")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ScoringSet:
        row = spark.read.schema(_SCHEMA).parquet(f"{path}/set").first()
        classifier: Linear | Model | None = None
        if row["weights"] is not None:
            classifier = Linear(tuple(row["weights"]), row["bias"])
        elif row["has_model"]:
            classifier = DefaultParamsReader.loadParamsInstance(f"{path}/classifier", spark)
        rebuilt = None
        if row["mean"] is not None:
            rebuilt = Reconstructor(np.array(row["mean"]), np.array(row["spread"]), np.array(row["axes"]))
        numbers = [tuple(row[c]) for c in ("features", "fill", "center", "scale")]
        return ScoringSet(*numbers, classifier, rebuilt, row["probability_cut"], row["anomaly_cut"])


def linear_part(model: Model) -> Linear | Model:
    """A fitted logistic regression as plain numbers; other models as they are."""
    if not (hasattr(model, "coefficients") and hasattr(model, "intercept")):
        return model
    return Linear(tuple(map(float, model.coefficients.toArray())), float(model.intercept))


def preparation(train: DataFrame, features: Sequence[str], medians: dict, moments: dict) -> ScoringSet:
    """A set without models from column medians and (mean, deviation) pairs."""
    fill = tuple(float((medians.get(c) or [0.0])[0]) for c in features)
    return ScoringSet(tuple(features), fill, tuple(float(moments[c][0]) for c in features), tuple(float(moments[c][1]) for c in features))
