"""Exploratory statistics: small result tables from one pass over the data each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import null_if_nan, ratio
from txrisk.operators.clean import unpivot_numeric
from txrisk.operators.hashing import key_counts
from txrisk.operators.ordering import exact_quantiles


def _melt(one_row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])
    return one_row.select(F.inline(entries), *[c for c in one_row.columns if c not in columns])


def missing_summary(df: DataFrame) -> DataFrame:
    """Count and share of NULL and NaN per column that has any, most first."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    absent = {c: (null_if_nan(F.col(c)) if c in floats else F.col(c)).isNull() for c in df.columns}
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(a).alias(c) for c, a in absent.items()])
    long = _melt(counts, df.columns, "column_name", "missing")
    return (
        long.filter(F.col("missing") > 0)
        .select("column_name", "missing", (100.0 * F.col("missing") / F.col("_rows")).alias("missing_pct"))
        .orderBy(F.col("missing").desc(), "column_name")
    )


def _summary(prefix_keys: Sequence[str], df: DataFrame, value: str) -> DataFrame:
    stats = df.groupBy(*prefix_keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], prefix_keys).select(
        *prefix_keys,
        F.get("quantiles", F.lit(0)).alias("q25"),
        F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q75"),
    )
    return stats.join(quartiles, list(prefix_keys), "left")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max: one row per column."""
    return _summary(["feature"], unpivot_numeric(df, columns), "value")


def describe_by_label(df: DataFrame, value: str, label: str) -> DataFrame:
    return _summary([label], df.select(label, null_if_nan(F.col(value)).alias(value)), value)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.col("n").desc(), column)
    return ordered.limit(k) if k else ordered


def fraud_type_counts(df: DataFrame, label: str = "is_fraud", kind: str = "fraud_type") -> DataFrame:
    return value_counts(df.filter(F.col(label)), kind)


def counts_by_time_label(df: DataFrame, part: Column, label: str, name: str = "part") -> DataFrame:
    """Rows per time part and class, side by side, 0 where there are none."""
    flag = F.col(label).cast("int")
    pivot = df.select(part.alias(name), flag.alias("_l")).groupBy(name).pivot("_l", [0, 1]).count()
    return pivot.na.fill(0).withColumnsRenamed({"0": "normal", "1": "fraud"})


def fraud_rate_by_category(df: DataFrame, category: str, label: str, k: int = 10) -> DataFrame:
    """The ``k`` categories with the highest fraud share."""
    rates = df.groupBy(category).agg((100.0 * F.avg(F.col(label).cast("double"))).alias("fraud_pct"))
    return rates.orderBy(F.col("fraud_pct").desc(), category).limit(k)


#: More columns than this are correlated by blocks, not by an aggregate per pair.
WIDE = 24
#: Columns of a block of the Gram matrices.
_BLOCK = 64
_SUMS = ("n", "si", "sj", "qi", "qj", "p")
_GRAM = "bi int, bj int, salt int, " + ", ".join(f"{s} array<double>" for s in _SUMS)


def _gram(batch: np.ndarray) -> dict[tuple[int, int], list[np.ndarray]]:
    """Sums over the rows where both columns are there, per pair of column blocks: count, values, squares, products."""
    there = ~np.isnan(batch)
    mask, x = there.astype("float64"), np.where(there, batch, 0.0)
    cuts = range(0, batch.shape[1], _BLOCK)
    out = {}
    for bi, i in enumerate(cuts):
        for bj, j in enumerate(cuts):
            if bi <= bj:
                xi, xj, mi, mj = x[:, i : i + _BLOCK], x[:, j : j + _BLOCK], mask[:, i : i + _BLOCK], mask[:, j : j + _BLOCK]
                out[bi, bj] = [mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj]
    return out


def _wide_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from masked Gram blocks: matrix products per batch, block sums merged in two levels.

    Values are taken off their column's mean first, so that squares do not cancel. A task holds six numbers per pair of
    columns.
    """
    d = len(columns)
    values = [null_if_nan(F.col(c)) for c in columns]
    means = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{i}") for i, v in enumerate(values)]).first()
    x = F.array(*[v - F.lit(float(means[i])) for i, v in enumerate(values)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            cells = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, d)
            for at, sums in _gram(cells).items():
                total[at] = [t + s for t, s in zip(total[at], sums)] if at in total else sums
        salt = int(np.random.default_rng().integers(0, 64))
        for (bi, bj), sums in total.items():
            cells = {name: pa.array([s.ravel().tolist()], pa.list_(pa.float64())) for name, s in zip(_SUMS, sums)}
            yield pa.RecordBatch.from_pydict({"bi": pa.array([bi], pa.int32()), "bj": pa.array([bj], pa.int32()), "salt": pa.array([salt], pa.int32()), **cells})

    def merged(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        return {name: np.sum(np.stack([np.asarray(v, dtype="float64") for v in rows[name]]), axis=0) for name in _SUMS}

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame([{"bi": first["bi"], "bj": first["bj"], "salt": first["salt"], **merged(rows)}])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(rows["bi"].iloc[0]), int(rows["bj"].iloc[0])
        s = merged(rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread_i, spread_j = s["qi"] - s["si"] ** 2 / s["n"], s["qj"] - s["sj"] ** 2 / s["n"]
            flat = (spread_i <= 1e-13 * s["qi"]) | (spread_j <= 1e-13 * s["qj"])
            corr = np.where(flat, np.nan, (s["p"] - s["si"] * s["sj"] / s["n"]) / np.sqrt(spread_i * spread_j))
        width = min(_BLOCK, d - bj * _BLOCK)
        out = []
        for at, c in enumerate(corr.tolist()):
            a, b = columns[bi * _BLOCK + at // width], columns[bj * _BLOCK + at % width]
            if bi < bj or at // width < at % width:
                out += [(a, b, c), (b, a, c)]
            elif at // width == at % width:
                out.append((a, a, 1.0))
        return pd.DataFrame(out, columns=["a", "b", "c"])

    parts = df.select(x.alias("x")).mapInArrow(partial, _GRAM)
    halfway = parts.groupBy("bi", "bj", "salt").applyInPandas(merge, _GRAM)
    cells = halfway.groupBy("bi", "bj").applyInPandas(finish, "a string, b string, c double")
    return cells.select("a", "b", null_if_nan(F.col("c")).alias("corr"))


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both; NULL where either does not vary (``corr`` is an error then)."""
    spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all column pairs, both triangles: one aggregate, or block sums for many columns.

    A pair is correlated over the rows where neither value is NULL or NaN; NULL where one of the two does not vary.
    """
    if len(columns) > WIDE:
        return _wide_correlations(df, list(columns))
    pairs = list(combinations(range(len(columns)), 2))
    sums = df.agg(
        *[_corr(null_if_nan(F.col(columns[i])), null_if_nan(F.col(columns[j]))).alias(f"c{i}_{j}") for i, j in pairs]
    )

    def entry(a: int, b: int, c: Column) -> Column:
        return F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), c.alias("corr"))

    cells = [entry(i, i, F.lit(1.0)) for i in range(len(columns))]
    for i, j in pairs:
        cells += [entry(i, j, F.col(f"c{i}_{j}")), entry(j, i, F.col(f"c{i}_{j}"))]
    return sums.select(F.inline(F.array(*cells)))


def target_correlation_topk(df: DataFrame, columns: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """The features most correlated with the target, highest first, without the target itself."""
    features = [c for c in columns if c != target]
    sums = df.agg(*[_corr(null_if_nan(F.col(c)), null_if_nan(F.col(target))).alias(c) for c in features])
    return _melt(sums, features, "feature", "corr").orderBy(F.col("corr").desc_nulls_last(), "feature").limit(k)


def histogram_by_label(df: DataFrame, value: str, label: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over the common range, rows per (label, bucket); last bin closed."""
    v = null_if_nan(F.col(value))
    clean = df.select(F.col(label), v.alias("_v")).filter(F.col("_v").isNotNull())
    span = clean.select(F.col("_v")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    bounds = span.select(F.struct("lo", "hi")).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    place = F.coalesce(ratio((F.col("_v") - lo) * bins, hi - lo), F.lit(0.0))
    bucket = F.least(F.floor(place).cast("int"), F.lit(bins - 1))
    counts = clean.groupBy(label, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("lower", lo + F.col("bucket") * (hi - lo) / bins)


def log_histogram_by_label(df: DataFrame, value: str, label: str, bins: int = 50) -> DataFrame:
    """The same on a log scale; values below zero have no place on it."""
    logs = df.filter(F.col(value) >= 0).select(label, F.log1p(F.col(value)).alias("_log"))
    return histogram_by_label(logs, "_log", label, bins)


def boxplot_by_label(df: DataFrame, value: str, label: str) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per class."""
    key_counts(df, label)  # one box per class: refuses a label with unboundedly many values
    box = exact_quantiles(df, value, [0.25, 0.5, 0.75], [label]).select(
        label,
        F.get("quantiles", F.lit(0)).alias("q25"),
        F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q75"),
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        df.select(label, value)
        .join(F.broadcast(box), label)
        .groupBy(label)
        .agg(
            *[F.max(c).alias(c) for c in ("q25", "median", "q75")],
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def class_weights(df: DataFrame, label: str, ratio: float | None = None) -> DataFrame:
    """total / (classes * count) per class; with ``ratio``, that for class 1 and 1 for every other."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if ratio is not None:
        return counts.withColumn("weight", F.when(F.col(label).cast("int") == 1, float(ratio)).otherwise(1.0))
    whole = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    whole = whole.select(F.struct("rows", "classes")).scalar()
    return counts.withColumn("weight", whole.getField("rows") / (whole.getField("classes") * F.col("n")))


def sample_head(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def topk(df: DataFrame, by: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The ``k`` rows with the largest (smallest) ``by``."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    return df.orderBy(key, tie).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
