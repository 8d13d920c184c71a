"""Row filters, casts, label handling, imputation and schema questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import default_tx_frequency as tx_frequency
from txrisk.functions.scalar import null_if_nan
from txrisk.operators.ordering import exact_quantiles
from txrisk.schema import ID_COLUMNS, LABEL_COLUMNS, numeric_columns, string_columns, time_columns


def drop_null_keys(df: DataFrame, subset: Sequence[str] = ("amount", "timestamp", "sender_account")) -> DataFrame:
    return df.na.drop(subset=[c for c in subset if c in df.columns])


def cast_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Cast to timestamp; text that is no timestamp becomes NULL."""
    return df.withColumn(column, F.col(column).try_cast("timestamp"))


def label_from_bool(df: DataFrame, source: str = "is_fraud", target: str = "fraud_label") -> DataFrame:
    return df.withColumn(target, F.col(source).cast("int"))


def target_resolution(df: DataFrame, target: str = "target") -> DataFrame:
    """``fraud_label`` where the table has it, else ``is_fraud`` as 0/1, else NULL."""
    if "fraud_label" in df.columns:
        label = F.col("fraud_label").cast("int")
    elif "is_fraud" in df.columns:
        label = F.col("is_fraud").cast("int")
    else:
        label = F.lit(None).cast("int")
    return df.withColumn(target, label)


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (``keep``..., feature, value) with doubles, NaN as NULL."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), null_if_nan(F.col(c)).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: its kind and how many values it has."""
    kinds = {
        **{c: "numeric" for c in numeric_columns(df.schema)},
        **{c: "categorical" for c in string_columns(df.schema)},
        **{c: "datetime" for c in time_columns(df.schema)},
    }
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds.get(c, "other")).alias("kind"),
                F.col(c).alias("non_null"),
            )
            for c in df.columns
        ]
    )
    return counts.select(F.inline(entries))


def feature_names(schema: T.StructType) -> list[str]:
    """Numeric columns that are neither ids nor labels."""
    return [c for c in numeric_columns(schema) if c not in ID_COLUMNS and c not in LABEL_COLUMNS]


def select_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *feature_names(df.schema))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULL and NaN with the column mean: one aggregate over all columns, no shuffle of rows."""
    means = df.agg(*[F.avg(null_if_nan(F.col(c))).alias(c) for c in columns])
    fill = means.select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(null_if_nan(F.col(c)), fill.getField(c)) for c in columns})


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(null_if_nan(F.col(c)), F.lit(0.0)) for c in columns})


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns in one pass; the result has one row per column."""
    table = exact_quantiles(unpivot_numeric(df, columns), "value", probs, ["feature"])
    return {r["feature"]: list(r["quantiles"]) for r in table.collect()}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = column_quantiles(df, columns, [0.5])
    return df.withColumns(
        {c: F.coalesce(null_if_nan(F.col(c)), F.lit(medians[c][0])) for c in columns if c in medians}
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the most frequent value of each column (the smallest on ties), NULL where there is none.

    One scan counts the values of all columns (a grouping set per column, combined before the shuffle); the ``mode``
    aggregate would hold all distinct values in one task.
    """
    kept = df.select(*columns)
    counts = kept.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)]
    )

    def top(i: int, c: str):
        mine = (F.col(f"_g{i}") == 0) & F.col(c).isNotNull()
        return F.min_by(c, F.when(mine, F.struct(-F.col("_n"), F.col(c)))).alias(c)

    return counts.agg(*[top(i, c) for i, c in enumerate(columns)])


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df
    fill = column_modes(df, columns).select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), fill.getField(c)) for c in columns})


def _eval_fallback(df: DataFrame, feature: str) -> Column:
    name = feature.lower()
    if any(mark in name for mark in ("time_since", "delta", "ratio")):
        return F.lit(0.0)
    if "avg_" in name or "max_" in name:
        base = feature.split("_")[1]
        if base in df.columns:
            return F.coalesce(null_if_nan(F.col(base)), F.lit(0.0))
    return F.lit(0.0)


def impute_eval(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median where a column has one; otherwise a default that depends on the feature's name."""
    medians = column_quantiles(df, columns, [0.5])
    fills = {c: F.lit(medians[c][0]) if c in medians else _eval_fallback(df, c) for c in columns}
    return df.withColumns({c: F.coalesce(null_if_nan(F.col(c)), fills[c]) for c in columns})


def default_tx_frequency(df: DataFrame, gap: str = "time_since_last_transaction") -> DataFrame:
    """Add ``transaction_frequency`` where it is missing."""
    if "transaction_frequency" in df.columns:
        return df
    seconds = F.col(gap) if gap in df.columns else None
    return df.withColumn("transaction_frequency", tx_frequency(seconds))


def common_features(reference: DataFrame, production: DataFrame, features: Sequence[str]) -> DataFrame:
    """For each wanted feature: is it in both tables, and how many values has it in each."""

    def counts(df: DataFrame, name: str) -> Column:
        present = [c for c in features if c in df.columns]
        fields = [F.count(F.col(c)).alias(c) for c in present] or [F.count(F.lit(1)).alias("_none")]
        agg = df.agg(*fields)
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in present])
        return agg.select(F.inline(entries)) if present else None

    spark = reference.sparkSession
    wanted = spark.createDataFrame([(f,) for f in features], "feature string")
    out = wanted
    for df, name in ((reference, "reference_values"), (production, "production_values")):
        found = counts(df, name)
        if found is None:
            out = out.withColumn(name, F.lit(None).cast("bigint"))
        else:
            out = out.join(F.broadcast(found), "feature", "left")
    both = F.col("reference_values").isNotNull() & F.col("production_values").isNotNull()
    return out.withColumn("common", both)
