"""Order-dependent primitives that survive hot groups.

``Window.partitionBy(k)`` puts every row of one ``k`` into one task. That is fine
for a million accounts of ordinary size and fatal when one account holds a third
of the table, or when there is no ``k`` at all (a global rank, a ROC curve).

``split_groups`` counts rows per group first (a map-side combined aggregate over
the key columns only). Groups under the limit go through the plain window. The rows
of larger ones are dealt by Spark's own range partitioner over (group, order) into
parts of a fixed size, written once, and the window runs per (group, part). Short parts
share a task: the number of tasks follows the rows, however small the parts are. What
crosses a part's border is carried over explicitly: totals of the earlier parts for
ranks and prefix sums, the last few rows before the part for row frames. No part of
the order passes through the driver, and the parts are fixed by being written, so a
retry sees the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txrisk.session import max_broadcast_bytes, max_group_rows, part_rows, scratch_path

PART = "_part"
_HALO = "_halo"
#: Rows a task deals at least (if there are as many); parts shorter than that are cut within it.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Layout:
    """The rows of groups that fit a task and, stored with the part they are in, those of larger groups."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    whole: DataFrame | None
    cut: DataFrame | None
    parts: int = 0

    @property
    def split(self) -> bool:
        return self.cut is not None

    def window(self, cut: bool) -> WindowSpec:
        return self.partition(cut).orderBy(*self.order)

    def partition(self, cut: bool) -> WindowSpec:
        return Window.partitionBy(*self.keys, *([PART] if cut else []))

    def both(self, whole: DataFrame | None, cut: DataFrame | None) -> DataFrame:
        """The results for the two kinds of rows as one table, in the types of the plain one."""
        if cut is None or whole is None:
            return whole if cut is None else cut
        kinds = {f.name: f.dataType for f in whole.schema}
        return whole.unionByName(cut.select(*[F.col(c).cast(kinds[c]).alias(c) for c in whole.columns]))


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """The table written once to the shared folder, and its rows (from the files' own counts)."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back, back.count()


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: a map-side combined count over the key columns only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()["n"]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, rows: int) -> DataFrame:
    """Join on equal or equally missing keys; ``rows`` of the right side decide whether it is broadcast."""
    renamed = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    if rows * (64 + 32 * len(renamed.columns)) <= max_broadcast_bytes(left.sparkSession):
        renamed = F.broadcast(renamed)
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def reusable(df: DataFrame, rows: int) -> DataFrame:
    """An aggregate that is read several times: recomputed while it is small, else written once."""
    return df if rows <= max_group_rows(df.sparkSession) else stored(df)[0]


def split_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, kept: bool = False) -> Layout:
    """Lay ``df`` out for ordered work per group.

    ``order`` must be columns that order the rows of a group uniquely (add the row id last), without NULLs. ``rows``
    is a known upper bound of the rows in any group; when it is small enough nothing has to be counted. ``kept`` says
    that ``df`` is a stored table, with ``rows`` rows if there are no keys.
    """
    keys, order = tuple(keys), tuple(order)
    limit = max_group_rows(df.sparkSession)
    if rows is not None and rows <= limit:
        return Layout(keys, order, df, None)
    if not keys:
        df, n = (df, rows) if kept and rows is not None else stored(df)
        return Layout(keys, order, df, None) if n <= limit else _dealt(keys, order, None, df, n)
    if largest_group(df, keys) <= limit:
        return Layout(keys, order, df, None)
    # From here on everything reads the copy, not the plan above.
    df = df if kept else stored(df)[0]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot, n_hot = stored(counts)
    n = hot.agg(F.sum("_n")).first()[0]
    named = hot.select(*keys)
    ordinary = _null_safe_join(df, named, keys, "left_anti", n_hot)
    return _dealt(keys, order, ordinary, _null_safe_join(df, named, keys, "left_semi", n_hot), n)


def _dealt(keys: tuple[str, ...], order: tuple[str, ...], whole: DataFrame | None, hot: DataFrame, rows: int) -> Layout:
    size = part_rows(hot.sparkSession)
    ranged = hot.repartitionByRange(math.ceil(rows / max(size, TASK_ROWS)), *keys, *order)
    if size < TASK_ROWS:
        # Rows that are equal in order have one rank, so that no part ends between them.
        place = F.rank().over(Window.partitionBy("_dealt_task").orderBy(*keys, *order)) - 1
        ranged = ranged.withColumn("_dealt_task", F.spark_partition_id().cast("long")).withColumn("_dealt_at", F.floor(place / size))
        ranged = ranged.withColumn(PART, F.shiftleft("_dealt_task", 33) + F.col("_dealt_at")).drop("_dealt_task", "_dealt_at")
    else:
        ranged = ranged.withColumn(PART, F.spark_partition_id())
    cut, _ = stored(ranged)
    return Layout(keys, order, whole, cut, math.ceil(rows / size))


def _totals_before(layout: Layout, sums: dict[str, Column]) -> tuple[DataFrame, int]:
    """Per (group, part): the totals of all earlier parts and of the whole group; one row per part and group."""
    totals, rows = stored(layout.cut.groupBy(*layout.keys, PART).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()]))
    before = Window.partitionBy(*layout.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*layout.keys)
    return totals.select(
        *layout.keys,
        PART,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"_whole_{n}") for n in sums],
    ), rows


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    totals: bool = False,
    rows: int | None = None,
    kept: bool = False,
) -> DataFrame:
    """Running totals ``{name}`` (current row included) in ``order`` within each group.

    ``totals=True`` adds the group totals as ``{name}_total``; ``rows`` and ``kept`` as in ``split_groups``.
    """
    layout = split_groups(df, keys, order, rows, kept)

    def local(part: DataFrame, cut: bool) -> DataFrame:
        running = layout.window(cut).rowsBetween(Window.unboundedPreceding, 0)
        cols = {n: F.sum(v).over(running) for n, v in sums.items()}
        if totals and not cut:
            cols.update({f"{n}_total": F.sum(v).over(layout.partition(cut)) for n, v in sums.items()})
        return part.withColumns(cols)

    whole = None if layout.whole is None else local(layout.whole, False)
    if not layout.split:
        return whole
    carried, n = _totals_before(layout, sums)
    joined = _null_safe_join(local(layout.cut, True), carried, (*layout.keys, PART), "left", n)
    final = {c: F.col(c) + F.col(f"_before_{c}") for c in sums}
    if totals:
        final.update({f"{c}_total": F.col(f"_whole_{c}") for c in sums})
    cut = joined.withColumns(final).drop(PART, *[f"_{w}_{c}" for c in sums for w in ("before", "whole")])
    return layout.both(whole, cut)


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    totals: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Dense position 1..n of each row in ``order`` within its group (``{name}_total`` = n)."""
    return prefix_sums(df, keys, order, {name: F.lit(1)}, totals=totals, rows=rows)


def take_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], quota: Column) -> DataFrame:
    """The first ``quota`` rows of each group; ``quota`` may use the row's own columns."""
    return group_rank(df, keys, order, "_rank").filter(F.col("_rank") <= quota).drop("_rank")


def _halo_rows(layout: Layout, reach: int, keep_first: bool) -> DataFrame:
    """For every part of a group, the last ``reach`` rows before it and, with ``keep_first``, the group's first row.

    A part's own last rows go to the next ``reach`` parts of its group, of which the last ``reach`` per part are kept:
    however few rows a part has, nothing nearer is missed.
    """
    keys, cut = list(layout.keys), layout.cut
    columns = cut.columns
    backwards = [F.col(c).desc() for c in layout.order]
    last = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*backwards))
    ends = cut.withColumn("_r", last).filter(F.col("_r") <= reach).drop("_r")
    present, n = stored(cut.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("_n")))
    numbered = present.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(PART))).drop("_n")
    placed = _null_safe_join(ends, numbered, (*keys, PART), "inner", n).drop(PART)
    spread = placed.withColumn("_no", F.explode(F.sequence(F.col("_no") + 1, F.col("_no") + reach)))
    nearest = F.row_number().over(Window.partitionBy(*keys, "_no").orderBy(*backwards))
    halo = spread.withColumn("_r", nearest).filter(F.col("_r") <= reach).drop("_r")
    if keep_first:
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*layout.order))
        heads = cut.withColumn("_r", first).filter(F.col("_r") == 1).drop("_r", PART)
        most = numbered.groupBy(*keys).agg(F.max("_no").alias("_most")).filter("_most > 1")
        everywhere = _null_safe_join(heads, most, keys, "inner", n).withColumn("_no", F.explode(F.sequence(F.lit(2), F.col("_most"))))
        # The first row goes in unless it is there; of equal rows in the halo each one counts.
        twin = F.row_number().over(Window.partitionBy(*keys, "_no", *layout.order).orderBy(*layout.order))
        halo = halo.withColumn("_twin", twin).unionByName(everywhere.select(*halo.columns).withColumn("_twin", F.lit(1)))
        halo = halo.dropDuplicates([*keys, "_no", *layout.order, "_twin"]).drop("_twin")
    back = numbered.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_no").alias("_hno"), PART)
    here = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)] + [F.col("_no") == F.col("_hno")]
    return halo.join(back, here, "inner").select(*columns)


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    build,
    keep_first: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Window columns that look back at most ``reach`` rows (or at the group's first row).

    ``build(window)`` returns name -> column. In a split group every part is preceded by a
    halo: the last ``reach`` (at least 1) rows before it, plus the group's first row with ``keep_first``
    (which needs keys).
    """
    if keep_first and not keys:
        raise ValueError("the first row of a group needs group keys")
    layout = split_groups(df, keys, order, rows)
    whole = None if layout.whole is None else layout.whole.withColumns(build(layout.window(False)))
    if not layout.split:
        return whole
    halo = _halo_rows(layout, reach, keep_first).withColumn(_HALO, F.lit(True))
    padded = layout.cut.withColumn(_HALO, F.lit(False)).unionByName(halo)
    cut = padded.withColumns(build(layout.window(True))).filter(~F.col(_HALO)).drop(PART, _HALO)
    return layout.both(whole, cut)


#: Relative accuracy of the sketch that brackets a rank: a quantile is off by 1 / this of the rows at most.
SKETCH = 10_000
#: Up to so many groups their ranges are literals of the plan, more are a stored table.
_FEW_GROUPS = 1000
#: A bracket is this many times the sketch's error wide on either side.
_MARGIN = 4


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), name: str = "quantiles"
) -> DataFrame:
    """Exact linearly interpolated quantiles per group as an array column, NULL and NaN ignored.

    While a task can hold a group's distinct values, the built-in aggregate. Otherwise selection by counting, in two
    scans: a sketch per group puts every wanted rank into a narrow range of values; then
    rows below the range and at its lower end are counted, and only values strictly inside, a thousandth of the rows at
    most, are kept and put in order. Nothing else is sorted or shuffled, all groups and ranks go together. Groups of
    less than ``SKETCH`` rows are all range.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    if largest_group(clean, keys) <= max_group_rows(df.sparkSession):
        # A task can hold the distinct values of a group.
        return clean.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias(name))
    inf = float("inf")
    edge = _MARGIN / SKETCH
    points = [q for p in probs for q in (max(0.0, p - edge), min(1.0, p + edge))]
    sketch = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", points, SKETCH).alias("_q"))

    def bound(i: int, low: bool) -> Column:
        open_end = probs[i] - edge <= 0 if low else probs[i] + edge >= 1
        far = F.lit(-inf if low else inf)
        return far if open_end else F.when(F.col("_n") < SKETCH, far).otherwise(F.get("_q", F.lit(2 * i + (not low))))

    marks = sketch.select(*keys, "_n", *[bound(i, low).alias(f"_{'lo' if low else 'hi'}{i}") for i in range(len(probs)) for low in (True, False)])
    if keys:
        few = marks.limit(_FEW_GROUPS + 1).collect()
        if len(few) <= _FEW_GROUPS:
            groups, largest = len(few), max((r["_n"] for r in few), default=0)
            marks = df.sparkSession.createDataFrame(few, marks.schema)
        else:
            marks, groups = stored(marks)
            largest = marks.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()["n"]
        placed = _null_safe_join(clean, marks, keys, "inner", groups)
    else:
        # One row: it becomes literals of the plan.
        row, groups = marks.first(), 1
        largest = row["_n"]
        placed = clean.withColumns({c: F.lit(row[c]) for c in marks.columns})
    # No more rows than this lie strictly inside a range, by the sketch's own bound; its ends may repeat.
    most = largest if largest < SKETCH else math.ceil(largest * 2 * (_MARGIN + 1) / SKETCH)
    if most > max_group_rows(df.sparkSession):
        return _by_running_counts(placed, probs, keys, name, groups)
    v, fields = F.col("_v"), [F.max("_n").alias("_n")]
    for i in range(len(probs)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        fields += [
            F.count_if(v < lo).alias(f"_below{i}"), F.count_if(v == lo).alias(f"_same{i}"), F.max(lo).alias(f"_lo{i}"), F.max(hi).alias(f"_hi{i}"),
            F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"_in{i}"),
        ]
    ranked = placed.groupBy(*keys).agg(*fields)

    def value_at(rank: Column, i: int) -> Column:
        past = rank - F.col(f"_below{i}") - F.col(f"_same{i}")
        last = past >= F.size(f"_in{i}")
        return F.when(past < 0, F.col(f"_lo{i}")).when(last, F.col(f"_hi{i}")).otherwise(F.get(f"_in{i}", past.cast("int")))

    def interpolated(i: int) -> Column:
        at = F.lit(probs[i]) * (F.col("_n") - 1)
        low, high, w = value_at(F.floor(at), i), value_at(F.ceil(at), i), at - F.floor(at)
        return F.when(low == high, low).otherwise((1 - w) * low + w * high)

    out = ranked.filter("_n > 0") if not keys else ranked
    return out.select(*keys, F.array(*[interpolated(i) for i in range(len(probs))]).alias(name))


def _by_running_counts(placed: DataFrame, probs: list[float], keys: list[str], name: str, groups: int) -> DataFrame:
    """The same for ranges of more rows than a task should hold: running counts of their distinct values, cut into parts."""
    within = [F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i)) for i in range(len(probs))]
    inside = placed.select(*keys, "_v", F.explode(F.array_compact(F.array(*within))).alias("_i"))
    counted, n = stored(inside.groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c")))
    below = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(probs))])
    entries = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p"), F.col(f"_b{i}").alias("_b")) for i, p in enumerate(probs)])
    wanted = below.select(*keys, (F.col("_n") - 1).alias("_last"), F.inline(entries)).withColumn("_at", F.col("_p") * F.col("_last"))
    ranked = prefix_sums(counted, [*keys, "_i"], ["_v"], {"_cum": F.col("_c")}, rows=n, kept=True)
    found = _null_safe_join(ranked, wanted, [*keys, "_i"], "inner", groups * len(probs))
    upto = F.col("_cum") + F.col("_b")

    def at(rank: Column) -> Column:
        return F.max(F.when((upto > rank) & (upto - F.col("_c") <= rank), F.col("_v")))

    share = F.max(F.col("_at") - F.floor("_at"))
    picks = found.groupBy(*keys, "_i").agg(at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"), share.alias("_w"))
    between = (1 - F.col("_w")) * F.col("_low") + F.col("_w") * F.col("_high")
    one = F.when((F.col("_w") == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(between)
    packed = F.sort_array(F.collect_list(F.struct("_i", one.alias("_x"))))
    out = picks.groupBy(*keys).agg(F.transform(packed, lambda e: e["_x"]).alias(name))
    return out if keys else out.filter(F.size(name) > 0)


def fetch_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float] | None:
    """The quantiles of one column as driver values: ``len(probs)`` numbers, for use as literals."""
    rows = exact_quantiles(df, value, probs).collect()
    return list(rows[0]["quantiles"]) if rows and rows[0]["quantiles"] is not None else None
