"""Fitted preprocessing: scaling, encoding, splits."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalar import null_if_nan
from txrisk.operators.clean import column_modes, column_quantiles
from txrisk.operators.hashing import few_counts, hash_cuts, key_counts, rank_at_most, with_hash
from txrisk.operators.ordering import group_rank


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column over the training rows.

    Two numbers per column come back to the driver and become literals, so that later passes
    over the scaled table do not repeat the aggregate. A deviation of 0 counts as 1.
    """
    fields = []
    for i, c in enumerate(columns):
        v = null_if_nan(F.col(c))
        fields += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = train.agg(*fields).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``train`` (default: the table itself)."""
    fitted = fit_scaler(train if train is not None else df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """A 0/1 column per category; other values (and NULL) are 0 everywhere."""
    return df.withColumns(
        {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in categories}
    )


def fit_categories(train: DataFrame, column: str) -> list[str]:
    """Sorted category list; it becomes the table's columns, so it has to be short."""
    return sorted(v for v in key_counts(train, column) if v is not None)


class _Columns(Params):
    """What the estimator and its model share."""

    numeric = Param(Params._dummy(), "numeric", "numeric input columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical input columns", TypeConverters.toListString)
    output = Param(Params._dummy(), "output", "name of the feature vector", TypeConverters.toString)

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), output: str = "features") -> None:
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), output=output)


class Preprocessor(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median and scale for numbers, most frequent value and one-hot for texts, all learned on the rows it is fitted on.

    The medians are exact, the deviations those of the population. Categories become vector slots, so they are refused
    beyond ``MAX_SLOTS``; a category not seen in training is all zeros.
    """

    MAX_SLOTS = 10_000

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        numbers = dataset.select(*[F.col(c).cast("double").alias(c) for c in numeric])
        medians = column_quantiles(numbers, numeric, [0.5]) if numeric else {}
        fills = {c: float((medians.get(c) or [0.0])[0]) for c in numeric}
        filled = numbers.withColumns({c: F.coalesce(null_if_nan(F.col(c)), F.lit(v)) for c, v in fills.items()})
        moments = fit_scaler(filled, numeric) if numeric else {}
        modes = column_modes(dataset, categorical).first().asDict() if categorical else {}
        found = self._categories(dataset, categorical)
        for c in categorical:
            if len(found[c]) > self.MAX_SLOTS:
                raise ValueError(f"column {c} has more than {self.MAX_SLOTS} categories")
        learned = {
            "numbers": [[c, fills[c], *map(float, moments[c])] for c in numeric],
            "texts": [[c, None if modes[c] is None else str(modes[c]), found[c]] for c in categorical],
        }
        model = PreprocessorModel(numeric, categorical, self.getOrDefault("output"))
        return model._set(learned=json.dumps(learned))

    def _categories(self, dataset: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
        """Sorted values of every column, one more than the bound at most."""
        return {
            c: [r[0] for r in dataset.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.MAX_SLOTS + 1).collect()]
            for c in columns
        }


def _one_hot_slots(value: Column, values: list[str]) -> Column:
    return F.transform(F.lit(values), lambda v: F.coalesce((v == value).cast("double"), F.lit(0.0)))


class PreprocessorModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """What a ``Preprocessor`` learned; saved and read back by Spark ML's own writer and reader."""

    learned = Param(Params._dummy(), "learned", "fills, scales, modes and categories as JSON", TypeConverters.toString)

    def names(self) -> list[str]:
        """What each slot of the vector stands for."""
        learned = json.loads(self.getOrDefault("learned"))
        return [n[0] for n in learned["numbers"]] + [f"{c}={v}" for c, _, values in learned["texts"] for v in values]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = json.loads(self.getOrDefault("learned"))
        numbers = [
            (F.coalesce(null_if_nan(F.col(c).cast("double")), F.lit(fill)) - F.lit(mean)) / F.lit(scale) for c, fill, mean, scale in learned["numbers"]
        ]
        parts = [F.array(*numbers).cast("array<double>")]
        for c, mode, values in learned["texts"]:
            if values:
                parts.append(_one_hot_slots(F.coalesce(F.col(c).cast("string"), F.lit(mode)), values))
        return dataset.withColumn(self.getOrDefault("output"), array_to_vector(F.concat(*parts)))


def preprocess_pipeline(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> Preprocessor:
    """The unfitted preprocessing: fit it on the training rows, then transform any table."""
    return Preprocessor(numeric, categorical, output)


def _split(df: DataFrame, key: Column, counts: dict, row_id: str, test: float, val: float, salt) -> DataFrame:
    tests = {k: round(test * n) for k, n in counts.items()}
    vals = {k: tests[k] + round(val * (n - tests[k])) for k, n in counts.items()}
    cuts = hash_cuts(df, key, row_id, salt, counts, {k: [tests[k], vals[k]] for k in counts})
    hashed = with_hash(df, row_id, salt)
    marked = rank_at_most(hashed, key, row_id, counts, {"_test": tests, "_val": vals}, cuts)
    split = F.when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")
    return marked.withColumn("split", split).drop("_u", "_test", "_val")


def split_stratified(
    df: DataFrame, label: str, row_id: str, test: float = 0.2, val: float = 0.25, salt: int = 42
) -> DataFrame:
    """Add ``split``: test, then ``val`` of the rest, else train, with exact shares per class.

    Few classes: a filter on the row's own hash, no row moves. Otherwise, however many classes there are, rows are
    ranked by the same hash within their class, and nothing about a class reaches the driver. Both ways, and a
    re-run, assign a row alike.
    """
    counts = few_counts(df, label)
    if counts is not None:
        return _split(df, F.col(label), counts, row_id, test, val, salt)
    ranked = group_rank(with_hash(df, row_id, salt), [label], ["_u", row_id], "_rank", totals=True)
    n = F.col("_rank_total")
    tests = F.rint(F.lit(test) * n)
    vals = tests + F.rint(F.lit(val) * (n - tests))
    split = F.when(F.col("_rank") <= tests, "test").when(F.col("_rank") <= vals, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_u", "_rank", "_rank_total")


def split_random(df: DataFrame, row_id: str, test: float = 0.2, val: float = 0.25, salt: int = 42) -> DataFrame:
    """The same without classes."""
    return _split(df, F.lit(0), {0: df.count()}, row_id, test, val, salt)
