"""Time-range windows per entity: velocity features and rolling statistics.

A sliding RANGE frame re-reads its frame for every row, which is quadratic in the rows an
entity has inside one window. Small entities use it anyway (one exchange, one sort).
For larger entities the same sums come from differences of prefix sums over their distinct
(entity, time) points: linear, and split across tasks when an entity is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import MICROS_PER_DAY, micros, null_if_nan, ratio
from txrisk.operators.ordering import prefix_sums, reusable
from txrisk.operators.sequence import entity_time_diff
from txrisk.session import ensure_checkpoint_dir, max_broadcast_bytes

#: Largest entity for which a sliding frame is acceptable.
RANGE_FRAME_ROWS_CONF = "spark.txrisk.rangeFrameRows"
DEFAULT_RANGE_FRAME_ROWS = 10_000


def _typed(df: DataFrame, measures: dict[str, Column], rows: int) -> dict[str, str | tuple[str, float]]:
    """Types in which sums are exact: bigint for whole numbers, else a decimal as fine as the largest sum leaves room for.

    Prefix differences cancel, so doubles would lose what a sliding frame keeps. The scale comes from the data: with
    the largest finite magnitude times the rows before the point, all other digits of the 38 are fraction.
    """
    kinds = df.select(*[m.alias(n) for n, m in measures.items()]).schema
    out = {f.name: "bigint" for f in kinds if isinstance(f.dataType, T.IntegralType)}
    rest = [f.name for f in kinds if f.name not in out]
    if rest:
        largest = df.agg(*[F.max(F.abs(_finite(measures[n]))).alias(n) for n in rest]).first()
        for n in rest:
            whole = math.ceil(math.log10(max(largest[n] or 0.0, 1e-300)) + math.log10(max(rows, 1)))
            # Beyond 38 digits all values are summed in a larger unit.
            unit = max(0, whole - 36)
            out[n] = (f"decimal(38,{min(37, max(0, 36 - max(whole, 0)))})", 10.0**unit if unit < 308 else 1e307)
    return out


def _finite(c: Column) -> Column:
    """The value as a double, NULL where it is infinite or NaN."""
    value = null_if_nan(c)
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def _exact(measures: dict[str, Column], kinds: dict) -> dict[str, Column]:
    """What is summed: whole numbers as they are, finite parts as decimals, infinities as counts of either sign."""
    out: dict[str, Column] = {}
    for n, m in measures.items():
        if kinds[n] == "bigint":
            out[n] = m.cast("bigint")
            continue
        kind, unit = kinds[n]
        value = m.cast("double")
        out[n] = F.coalesce(_finite(m) / F.lit(unit), F.lit(0.0)).cast(kind)
        for mark, sign in (("_up", "+"), ("_down", "-")):
            out[n + mark] = (value == F.lit(float(f"{sign}inf"))).cast("bigint")
        out[n + "_nan"] = F.isnan(value).cast("bigint")
    return out


def _value_of(n: str, kind, difference: Callable[[str], Column]) -> Column:
    """A sum as a double again; NaN and infinities win over finite parts as they do in a sum of doubles."""
    if kind == "bigint":
        return difference(n).cast("double")
    up, down, odd = (difference(n + mark) > 0 for mark in ("_up", "_down", "_nan"))
    finite = difference(n).cast("double") * F.lit(kind[1])
    inf = F.lit(float("inf"))
    return F.when(odd | (up & down), F.lit(float("nan"))).when(up, inf).when(down, -inf).otherwise(finite)


def _prefix_frames(
    df: DataFrame, onto: DataFrame, entity: str, measures: dict[str, Column], starts: dict[str, int], end_inclusive: bool
) -> DataFrame:
    """``onto`` with the sums of ``measures`` in ``df`` over [t + start, t) or [t + start, t] for each frame.

    Every distinct (entity, time) point contributes itself plus one probe per frame at the
    frame's start; a probe sorts before the data at its position.
    """
    n_rows = df.count()
    kinds = _typed(df, measures, n_rows)
    exact = _exact(measures, kinds)
    points = df.groupBy(entity, "_us").agg(*[F.sum(m).alias(n) for n, m in exact.items()])
    types = {f.name: f.dataType for f in df.select(*[m.alias(n) for n, m in exact.items()]).schema}
    points = reusable(points.withColumns({n: F.col(n).cast(types[n]) for n in exact}), n_rows)
    names, data_kind = list(starts), len(starts)
    data = points.select(entity, F.col("_us").alias("_pos"), F.lit(data_kind).alias("_kind"), "_us", *[F.col(n) for n in exact])
    shifted = [F.struct((F.col("_us") + s).alias("_pos"), F.lit(i).alias("_kind")) for i, s in enumerate(starts.values())]
    probes = points.select(entity, "_us", F.inline(F.array(*shifted))).select(
        entity, "_pos", "_kind", "_us", *[F.lit(0).cast(types[n]).alias(n) for n in exact]
    )
    running = prefix_sums(
        data.unionByName(probes), [entity], ["_pos", "_kind"], {f"_cum_{n}": F.col(n) for n in exact}
    )
    picks = []
    for n in exact:
        until = F.col(f"_cum_{n}") if end_inclusive else F.col(f"_cum_{n}") - F.col(n)
        picks.append(F.max(F.when(F.col("_kind") == data_kind, until)).alias(f"_end_{n}"))
        picks += [F.max(F.when(F.col("_kind") == i, F.col(f"_cum_{n}"))).alias(f"_start{i}_{n}") for i in range(data_kind)]
    spans = running.groupBy(entity, "_us").agg(*picks)

    def between(i: int) -> Callable[[str], Column]:
        return lambda n: F.col(f"_end_{n}") - F.col(f"_start{i}_{n}")

    sums = spans.select(
        F.col(entity).alias("_e"),
        F.col("_us").alias("_t"),
        *[_value_of(n, kinds[n], between(i)).alias(f"_{f}_{n}") for i, f in enumerate(names) for n in measures],
    )
    # One point per (entity, time): rows join it many-to-one; AQE splits a hot point's rows.
    cond = F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_us") == F.col("_t"))
    return onto.join(sums, cond, "left").drop("_e", "_t")


def _frame_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(RANGE_FRAME_ROWS_CONF, str(DEFAULT_RANGE_FRAME_ROWS)))


def _by_size(df: DataFrame, entity: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary entities, rows of large entities); None for a part that is empty.

    The large entities are told apart by a broadcast list while that list is short enough;
    otherwise all rows count as large.
    """
    limit = _frame_rows(df)
    counts = df.groupBy(entity).count()
    profile = counts.agg(F.count_if(F.col("count") > limit).alias("large"), F.count(F.lit(1)).alias("all")).first()
    if not profile["large"]:
        return df, None
    # Both parts and every pass over the large one read the input: it is written once.
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    counts = df.groupBy(entity).count()
    if profile["large"] == profile["all"] or profile["large"] * 128 > max_broadcast_bytes(df.sparkSession):
        return None, df
    large = counts.filter(F.col("count") > limit).select(F.col(entity).alias("_large"))
    same = F.col(entity).eqNullSafe(F.col("_large"))
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def _framed(
    df: DataFrame,
    entity: str,
    windows: Sequence[int],
    bounds: tuple[int, int],
    direct: Callable[[int, WindowSpec], dict[str, Column]],
    measures: dict[str, Column],
    derived: Callable[[int], dict[str, Column]],
    extend: Callable[[DataFrame, int | None], DataFrame] = lambda part, rows: part,
) -> DataFrame:
    """Columns per window, by sliding frames for ordinary entities and prefix sums for large ones.

    ``bounds`` are added to the frame's ends: [t - w + bounds[0], t + bounds[1]] in microseconds.
    ``extend`` adds further columns to a part; it also gets the largest entity's rows if bounded.
    """
    small, large = _by_size(df, entity)
    parts = []
    if small is not None:
        cols: dict[str, Column] = {}
        for w in windows:
            frame = Window.partitionBy(entity).orderBy("_us").rangeBetween(-w * MICROS_PER_DAY + bounds[0], bounds[1])
            cols.update(direct(w, frame))
        parts.append(extend(small, _frame_rows(df)).withColumns(cols))
    if large is not None:
        starts = {f"{w}d": -w * MICROS_PER_DAY + bounds[0] for w in windows}
        summed = _prefix_frames(large, extend(large, None), entity, measures, starts, end_inclusive=bounds[1] == 0)
        cols = {name: c for w in windows for name, c in derived(w).items()}
        parts.append(summed.withColumns(cols).drop(*[f"_{f}_{n}" for f in starts for n in measures]))
    return reduce(DataFrame.unionByName, parts).drop("_us")


def velocity_features(
    df: DataFrame,
    entity: str,
    time: str,
    row_id: str,
    amount: str | None = None,
    windows: Sequence[int] = (1, 7, 30),
) -> DataFrame:
    """Count, sum and mean over the ``w`` days before each row: [t - w, t)."""
    timed = df.withColumn("_us", micros(F.col(time)))
    measures = {"n": F.lit(1)}
    if amount:
        value = null_if_nan(F.col(amount))
        measures.update(v=F.coalesce(value, F.lit(0.0)), nv=value.isNotNull().cast("int"))

    def names(w: int) -> tuple[str, str, str]:
        return f"{entity}_txn_count_{w}d", f"{entity}_amount_sum_{w}d", f"{entity}_amount_mean_{w}d"

    def direct(w: int, frame: WindowSpec) -> dict[str, Column]:
        count, total, mean = names(w)
        out = {count: F.count(F.lit(1)).over(frame)}
        if amount:
            out.update({total: F.coalesce(F.sum(value).over(frame), F.lit(0.0)), mean: F.avg(value).over(frame)})
        return out

    def derived(w: int) -> dict[str, Column]:
        count, total, mean = names(w)
        out = {count: F.col(f"_{w}d_n").cast("bigint")}
        if amount:
            s, n = F.col(f"_{w}d_v"), F.col(f"_{w}d_nv")
            out.update({total: s, mean: F.when(n > 0, ratio(s, n))})
        return out

    def extend(part: DataFrame, rows: int | None) -> DataFrame:
        return entity_time_diff(part, entity, time, row_id, rows)

    return _framed(timed, entity, windows, (0, -1), direct, measures, derived, extend)


def rolling_time_aggs(
    df: DataFrame, group: str, value: str | Sequence[str], time: str = "timestamp", windows: Sequence[int] = (7,)
) -> DataFrame:
    """Mean, sample deviation and count over (t - w days, t] per group, of one or several value columns in one pass.

    NaN counts as missing.
    """
    values = [value] if isinstance(value, str) else list(value)
    timed = df.withColumn("_us", micros(F.col(time)))
    clean = {v: null_if_nan(F.col(v)) for v in values}
    # Squares are summed around the overall mean so that the variance does not cancel.
    means = df.agg(*[F.avg(_finite(c)).alias(v) for v, c in clean.items()]).first()
    centres = {v: F.lit(float(means[v] or 0.0)) for v in values}
    measures: dict[str, Column] = {}
    for i, (v, c) in enumerate(clean.items()):
        off = F.coalesce(c - centres[v], F.lit(0.0))
        measures.update({f"n{i}": c.isNotNull().cast("int"), f"d{i}": off, f"q{i}": off * off})

    def names(v: str, w: int) -> tuple[str, str, str]:
        stem = f"{group}_{v}_{w}d"
        return f"{stem}_mean", f"{stem}_std", f"{stem}_count"

    def direct(w: int, frame: WindowSpec) -> dict[str, Column]:
        out = {}
        for v, c in clean.items():
            mean, std, count = names(v, w)
            out.update({mean: F.avg(c).over(frame), std: F.stddev_samp(c).over(frame), count: F.count(c).over(frame)})
        return out

    def derived(w: int) -> dict[str, Column]:
        out = {}
        for i, v in enumerate(values):
            mean, std, count = names(v, w)
            n, s, q = (F.col(f"_{w}d_{m}{i}") for m in ("n", "d", "q"))
            spread = F.greatest(ratio(q - ratio(s * s, n), n - 1), F.lit(0.0))
            out.update(
                {
                    mean: F.when(n > 0, centres[v] + ratio(s, n)),
                    std: F.when(n > 1, F.sqrt(spread)),
                    count: n.cast("bigint"),
                }
            )
        return out

    return _framed(timed, group, windows, (1, 0), direct, measures, derived)


def rolling_features(
    df: DataFrame, groups: Sequence[str], values: Sequence[str], time: str, windows: Sequence[int]
) -> DataFrame:
    """``rolling_time_aggs`` for every group and value column: one pass per group for all values."""
    return reduce(lambda out, g: rolling_time_aggs(out, g, values, time, windows), groups, df)
