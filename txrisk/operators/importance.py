"""Which features a model leans on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txrisk.functions.random import det_rand
from txrisk.operators.evaluation import roc_auc
from txrisk.operators.ordering import row_frames


def reconstruction_importance(
    df: DataFrame, original: str, rebuilt: str, names: Sequence[str] | None = None, k: int = 10
) -> DataFrame:
    """Mean absolute reconstruction error per feature position, largest first."""
    gaps = F.zip_with(original, rebuilt, lambda a, b: F.abs(a - b))
    means = df.select(F.posexplode(gaps).alias("position", "_gap")).groupBy("position").agg(F.avg("_gap").alias("error"))
    if names is not None:
        means = means.withColumn("feature", F.element_at(F.lit(list(names)), F.col("position") + 1))
    return means.orderBy(F.col("error").desc(), "position").limit(k)


def _shuffled(df: DataFrame, features: Sequence[str], row_id: str, salt) -> DataFrame:
    """Each row with the feature values of its predecessor in hash order (the first gets the last's).

    A permutation of the rows without a driver-side shuffle and without a join.
    """
    hashed = df.withColumn("_u", det_rand(F.col(row_id), salt))
    values = F.struct(*features)

    def build(w: WindowSpec):
        return {"_partner": F.lag(values).over(w)}

    last = hashed.agg(F.max_by(values, F.struct("_u", row_id)).alias("v")).select("v").scalar()
    rotated = row_frames(hashed, [], ["_u", row_id], 1, build)
    return rotated.withColumn("_partner", F.coalesce("_partner", last)).drop("_u")


def permuted_variants(df: DataFrame, features: Sequence[str], row_id: str, salt) -> DataFrame:
    """Variant -1 is the table itself, variant j has feature j taken from another row."""
    rotated = _shuffled(df, features, row_id, salt)
    spread = rotated.withColumn("variant", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = {
        f: F.when(F.col("variant") == j, F.col(f"_partner.{f}")).otherwise(F.col(f)) for j, f in enumerate(features)
    }
    return spread.withColumns(swapped).drop("_partner")


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    score: Callable[[DataFrame], DataFrame],
    label: str | None = None,
    repeats: int = 1,
    salt: int = 0,
) -> DataFrame:
    """Mean and deviation of the loss in AUC (with a label) or the gain in mean score (without).

    ``score`` adds a ``score`` column to a table with the feature columns.
    """
    kept = df.select(row_id, *([label] if label else []), *features)
    parts = [
        permuted_variants(kept, features, row_id, f"{salt}-{r}").withColumn("repeat", F.lit(r)) for r in range(repeats)
    ]
    scored = score(reduce(DataFrame.unionByName, parts))
    if label:
        quality = roc_auc(scored, "score", label, ["repeat", "variant"]).withColumnRenamed("auc", "quality")
    else:
        quality = scored.groupBy("repeat", "variant").agg((-F.avg("score")).alias("quality"))
    # repeats * (features + 1) rows from here on.
    untouched = F.max(F.when(F.col("variant") == -1, F.col("quality"))).over(Window.partitionBy("repeat"))
    drops = quality.withColumn("base", untouched).filter(F.col("variant") >= 0)
    names = F.element_at(F.lit(list(features)), F.col("variant") + 1)
    return drops.groupBy(names.alias("feature")).agg(
        F.avg(F.col("base") - F.col("quality")).alias("importance"),
        F.coalesce(F.stddev_pop(F.col("base") - F.col("quality")), F.lit(0.0)).alias("importance_std"),
    )


def builtin_importance(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """The fitted tree model's own importances, largest first."""
    values = model.featureImportances.toArray().tolist()
    table = df.sparkSession.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
