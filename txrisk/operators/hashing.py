"""Exact random subsets without shuffling the rows.

"The first n rows of a group in hash order" is a uniform sample of exactly n rows. Ranking
the whole table for it would sort everything; only the n-th (hash, id) pair is needed. It is
found among the few rows whose hash is close to n / size, and then applied as a filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.random import det_rand
from txrisk.operators.ordering import prefix_sums, reusable

_SIGMAS = 8.0


#: More distinct values than this and a column is no category: refused rather than collected.
MAX_CATEGORIES = 100_000
#: Up to so many keys are part of the plan.
LITERAL_KEYS = 16


def key_counts(df: DataFrame, key: str) -> dict:
    """Rows per value of a category column."""
    rows = df.groupBy(key).count().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{key} has more than {MAX_CATEGORIES} distinct values")
    return {r[0]: r[1] for r in rows}


def few_counts(df: DataFrame, key: str) -> dict | None:
    """Rows per value of a column of at most ``LITERAL_KEYS`` values, else None."""
    rows = df.groupBy(key).count().limit(LITERAL_KEYS + 1).collect()
    return {r[0]: r[1] for r in rows} if len(rows) <= LITERAL_KEYS else None


def _cuts(df: DataFrame, key: Column, row_id: str, salt, counts: dict, ranks: dict, slack: float) -> dict:
    spark = df.sparkSession
    narrow = df.select(key.alias("_key"), det_rand(F.col(row_id), salt).alias("_u"), F.col(row_id).alias("_id"))
    rows = []
    for k, wanted in ranks.items():
        n = counts[k]
        for r in sorted(set(wanted)):
            if 0 < r < n:
                width = slack * (math.sqrt(n) + 1) / n
                rows.append((k, r, r / n - width, r / n + width))
    if not rows:
        return {}
    schema = T.StructType(
        [
            T.StructField("_bkey", narrow.schema["_key"].dataType),
            T.StructField("_rank", T.LongType()),
            T.StructField("_lo", T.DoubleType()),
            T.StructField("_hi", T.DoubleType()),
        ]
    )
    if len(ranks) == 1:
        # One key: nothing to join on, the few brackets are literals of the plan.
        marks = [
            F.struct(F.lit(r).cast("bigint").alias("_rank"), F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi"))
            for _, r, lo, hi in rows
        ]
        only = narrow.filter(F.col("_key").eqNullSafe(F.lit(rows[0][0])))
        near = only.select(F.col("_key").alias("_bkey"), "_u", "_id", F.inline(F.array(*marks)))
    else:
        brackets = spark.createDataFrame(rows, schema)
        near = narrow.join(F.broadcast(brackets), F.col("_key").eqNullSafe(F.col("_bkey")))
    # One scan: all rows before a bracket collapse into one counted row on the map side, the few
    # rows inside it stay themselves. The running count is then the rank.
    before = F.col("_u") < F.col("_lo")
    first_id = F.lit(0 if isinstance(narrow.schema["_id"].dataType, T.NumericType) else "").cast(narrow.schema["_id"].dataType)
    counted = (
        near.filter(F.col("_u") <= F.col("_hi"))
        .groupBy(
            "_bkey",
            "_rank",
            F.when(before, -1.0).otherwise(F.col("_u")).alias("_u"),
            F.when(before, first_id).otherwise(F.col("_id")).alias("_id"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    bound = max(counts[k] for k in ranks)
    ranked = prefix_sums(
        reusable(counted, bound), ["_bkey", "_rank"], ["_u", "_id"], {"_r": F.col("_n")}, rows=min(bound, _inside(bound, slack))
    )
    hits = ranked.filter((F.col("_r") == F.col("_rank")) & (F.col("_u") >= 0))
    return {(r["_bkey"], r["_rank"]): (r["_u"], r["_id"]) for r in hits.collect()}


def _inside(n: int, slack: float) -> int:
    """More rows than a bracket of this slack can be expected to hold (eight more sigmas of its own)."""
    if math.isinf(slack):
        return n
    expected = 2 * slack * (math.sqrt(n) + 1)
    return int(expected + slack * math.sqrt(expected) + 100)


def hash_cuts(df: DataFrame, key: Column, row_id: str, salt, counts: dict, ranks: dict) -> dict:
    """(key, rank) -> the (hash, id) pair of that rank within the key.

    ``counts`` gives the rows per key, ``ranks`` the wanted ranks per key. Ranks outside
    1..n-1 need no cut and are left out.
    """
    wanted = {(k, r) for k, rs in ranks.items() for r in rs if 0 < r < counts[k]}
    found = _cuts(df, key, row_id, salt, counts, ranks, _SIGMAS)
    if wanted - set(found):
        # The bracket missed (odds below 1e-14 for a fair hash): search without one.
        found = _cuts(df, key, row_id, salt, counts, ranks, math.inf)
    return found


def rank_at_most(hashed: DataFrame, key: Column, row_id: str, counts: dict, limits: dict[str, dict], cuts: dict) -> DataFrame:
    """Add a column per name in ``limits``: is the row among the first ``limits[name][key]`` of its key in hash order?

    ``hashed`` has the row's hash in ``_u``. The keys are a table that is joined by broadcast (at most
    ``MAX_CATEGORIES`` short rows), so the expression does not grow with them; up to ``LITERAL_KEYS`` keys are one literal
    array, which needs no join. Rows of other keys are not among the first.
    """
    ident = F.col(row_id)
    keys = sorted({k for of in limits.values() for k in of}, key=repr)
    id_type = hashed.schema[row_id].dataType
    fields, rows = [T.StructField("_lkey", hashed.select(key.alias("k")).schema["k"].dataType)], []
    for i in range(len(limits)):
        fields += [
            T.StructField(f"_all{i}", T.BooleanType()),
            T.StructField(f"_u{i}", T.DoubleType()),
            T.StructField(f"_id{i}", id_type),
        ]
    for k in keys:
        row: list = [k]
        for of in limits.values():
            limit = of.get(k, 0)
            row += [True, None, None] if limit >= counts[k] else [False, *cuts.get((k, limit), (None, None))]
        rows.append(tuple(row))
    if len(rows) <= LITERAL_KEYS:
        structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)]) for row in rows]
        hit = F.get(F.filter(F.array(*structs), lambda s: key.eqNullSafe(s["_lkey"])), F.lit(0)) if rows else F.lit(None)
        marked = hashed.withColumn("_hit", hit)
        marked = marked.withColumns({f.name: F.col("_hit")[f.name] if rows else F.lit(None).cast(f.dataType) for f in fields})
        listed = F.col("_hit").isNotNull()
    else:
        table = hashed.sparkSession.createDataFrame(rows, T.StructType(fields)).withColumn("_listed", F.lit(True))
        marked = hashed.join(F.broadcast(table), key.eqNullSafe(F.col("_lkey")), "left")
        listed = F.coalesce("_listed", F.lit(False))
    u = F.col("_u")
    verdicts = {
        name: listed & F.coalesce(F.col(f"_all{i}") | (u < F.col(f"_u{i}")) | ((u == F.col(f"_u{i}")) & (ident <= F.col(f"_id{i}"))), F.lit(False))
        for i, name in enumerate(limits)
    }
    return marked.withColumns(verdicts).drop("_listed", "_hit", *[f.name for f in fields])


def with_hash(df: DataFrame, row_id: str, salt, name: str = "_u") -> DataFrame:
    """The row's hash as a column of its own, so that several conditions share one digest."""
    return df.withColumn(name, det_rand(F.col(row_id), salt))


def first_by_hash(df: DataFrame, key: str, row_id: str, salt, limits: dict, counts: dict | None = None) -> DataFrame:
    """Exactly ``limits[key]`` rows of each listed key (all, if it has fewer); others are dropped."""
    counts = counts or key_counts(df, key)
    limits = {k: v for k, v in limits.items() if k in counts}
    cuts = hash_cuts(df, F.col(key), row_id, salt, counts, {k: [v] for k, v in limits.items()})
    hashed = with_hash(df, row_id, salt)
    return rank_at_most(hashed, F.col(key), row_id, counts, {"_first": limits}, cuts).filter("_first").drop("_u", "_first")


def shuffle_rows(df: DataFrame, row_id: str, salt: int = 1) -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(det_rand(F.col(row_id), salt), row_id)
