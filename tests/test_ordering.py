"""Ranks, prefix sums, row frames and quantiles give the same answers when groups are split."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import sequence, velocity
from txrisk.operators.hashing import first_by_hash, key_counts
from txrisk.operators.ordering import exact_quantiles, group_rank, prefix_sums, row_frames, split_groups
from txrisk.session import MAX_GROUP_ROWS_CONF, PART_ROWS_CONF


def skewed(spark, rows=600):
    """Account 0 holds a third of all rows, many of them at the same moment."""
    i = F.col("id")
    return spark.range(rows).select(
        i.alias("transaction_id"),
        F.when(i % 3 == 0, 0).otherwise(i % 37).alias("sender_account"),
        F.timestamp_seconds(1_700_000_000 + F.floor(F.pow(i % 101, 2)) * 600).alias("timestamp"),
        ((i * 7919) % 1000 / 10.0).alias("amount"),
    )


def rows_of(df, *order):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.orderBy(*order).collect()]


def both_ways(spark, settings, build, *order, limit=20):
    plain = rows_of(build(), *order)
    settings(MAX_GROUP_ROWS_CONF, limit)
    return plain, rows_of(build(), *order)


def test_hot_group_is_split_into_parts_of_a_fixed_size(spark, small_groups):
    layout = split_groups(skewed(spark), ["sender_account"], ["amount", "transaction_id"])
    assert layout.split and layout.whole.filter("sender_account = 0").count() == 0
    sizes = layout.cut.groupBy("sender_account", "_part").count()
    assert sizes.filter("sender_account = 0").count() >= 200 / 20
    assert sizes.agg(F.max("count")).first()[0] <= 20
    # No part overlaps another one.
    spans = layout.cut.filter("sender_account = 0").groupBy("_part").agg(
        F.min(F.struct("amount", "transaction_id")).alias("lo"), F.max(F.struct("amount", "transaction_id")).alias("hi")
    ).orderBy("_part").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_short_parts_share_a_task(spark, settings):
    settings(MAX_GROUP_ROWS_CONF, 100)
    settings(PART_ROWS_CONF, 5)
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("o"), "id")
    layout = split_groups(rows, ["g"], ["o", "id"])
    parts = layout.cut.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct("g", "o")).alias("lo"), F.max(F.struct("g", "o")).alias("hi")).orderBy("_part").collect()
    assert sum(p["n"] for p in parts) == 4000 and len(parts) >= 800 and max(p["n"] for p in parts) <= 5
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    # One range of the partitioner deals all of them: parts are numbered within it.
    assert len({p["_part"] >> 33 for p in parts}) == 1


def test_rows_equal_in_order_stay_in_one_part(spark, settings):
    settings(MAX_GROUP_ROWS_CONF, 100)
    settings(PART_ROWS_CONF, 5)
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 6).alias("o"))
    cut = split_groups(rows, ["g"], ["o"]).cut
    assert cut.groupBy("g", "o").agg(F.count_distinct("_part").alias("n")).agg(F.max("n")).first()[0] == 1
    assert cut.count() == 4000 and cut.select("_part").distinct().count() > 500


def test_no_array_and_no_edges_in_the_plan_of_split_groups(spark, small_groups):
    plan = sequence.account_history(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    assert "array<" not in plan and "_coarse" not in plan and "Exchange" in plan


def test_parts_shorter_than_the_reach_of_a_frame(spark, settings):
    def build():
        return row_frames(
            skewed(spark, 90), ["sender_account"], ["transaction_id"], 7,
            lambda w: {"back": F.lag("amount", 7).over(w), "low": F.min("transaction_id").over(w.rowsBetween(-7, -1))},
        )

    plain, split = both_ways(spark, settings, build, "transaction_id", limit=2)
    assert plain == split


@pytest.mark.parametrize("bad", [[float("inf")], [float("inf"), float("-inf")], [float("nan"), float("inf")], [1e300, -1e300, 1e308]])
def test_velocity_of_infinite_and_huge_values(spark, settings, bad):
    def build():
        df = skewed(spark)
        value = F.element_at(F.lit(bad), (F.col("transaction_id") % len(bad) + 1).cast("int"))
        df = df.withColumn("amount", F.when(F.col("transaction_id") % 97 == 3, value).otherwise(F.col("amount")))
        return velocity.velocity_features(df, "sender_account", "timestamp", "transaction_id", "amount", [3])

    def close(rows):
        return [tuple("nan" if isinstance(v, float) and v != v else v for v in r) for r in rows]

    names = ["transaction_id", "sender_account_txn_count_3d", "sender_account_amount_sum_3d", "sender_account_amount_mean_3d"]
    plain = close(rows_of(build().select(*names), "transaction_id"))
    settings(velocity.RANGE_FRAME_ROWS_CONF, 5)
    for limit in (10_000, 20):
        settings(MAX_GROUP_ROWS_CONF, limit)
        got = close(rows_of(build().select(*names), "transaction_id"))
        if max(abs(v) for v in bad if v == v) < float("inf"):
            # Sums of doubles of very different size depend on their order.
            assert [r[:2] for r in got] == [r[:2] for r in plain]
            assert np.allclose([r[2] for r in got], [r[2] for r in plain], rtol=1e-9, atol=1e284)
        else:
            assert got == plain


def test_small_groups_are_left_alone(spark):
    assert not split_groups(skewed(spark), ["sender_account"], ["transaction_id"]).split


@pytest.mark.parametrize("keys", [[], ["sender_account"]])
def test_rank_is_dense_when_split(spark, settings, keys):
    plain, split = both_ways(
        spark, settings, lambda: group_rank(skewed(spark), keys, ["amount", "transaction_id"], totals=True), "transaction_id"
    )
    assert plain == split
    if not keys:
        assert sorted(r[4] for r in split) == list(range(1, 601))


@pytest.mark.parametrize("keys", [[], ["sender_account"]])
def test_prefix_sums_when_split(spark, settings, keys):
    plain, split = both_ways(
        spark,
        settings,
        lambda: prefix_sums(skewed(spark), keys, ["transaction_id"], {"s": F.col("amount")}, totals=True),
        "transaction_id",
    )
    assert plain == split


def test_null_group_is_a_group(spark, settings):
    def build():
        df = skewed(spark).withColumn("g", F.when(F.col("sender_account") != 0, F.col("sender_account")))
        return group_rank(df, ["g"], ["transaction_id"]).select("transaction_id", "rank")

    plain, split = both_ways(spark, settings, build, "transaction_id")
    assert plain == split


def test_row_frames_when_split(spark, settings):
    def build():
        return row_frames(
            skewed(spark), ["sender_account"], ["amount", "transaction_id"], 3,
            lambda w: {"back": F.lag("amount", 3).over(w), "mean": F.avg("amount").over(w.rowsBetween(-3, -1))},
        )

    plain, split = both_ways(spark, settings, build, "transaction_id")
    assert plain == split and len(split) == 600


@pytest.mark.parametrize("limit", [3, 20, 150])
def test_account_features_when_split(spark, settings, limit):
    plain, split = both_ways(spark, settings, lambda: sequence.account_history(skewed(spark)), "transaction_id", limit=limit)
    assert plain == split


def test_whole_history_features_when_split(spark, settings):
    plain, split = both_ways(spark, settings, lambda: sequence.history_features(skewed(spark)), "transaction_id")
    assert plain == split


def test_velocity_by_prefix_sums(spark, settings):
    def build():
        return velocity.velocity_features(skewed(spark), "sender_account", "timestamp", "transaction_id", "amount", [1, 7])

    plain = rows_of(build(), "transaction_id")
    settings(velocity.RANGE_FRAME_ROWS_CONF, 5)
    assert rows_of(build(), "transaction_id") == plain
    settings(MAX_GROUP_ROWS_CONF, 20)
    assert rows_of(build(), "transaction_id") == plain


def test_rolling_by_prefix_sums(spark, settings):
    def build():
        out = velocity.rolling_time_aggs(skewed(spark), "sender_account", "amount", "timestamp", [2])
        return out.withColumns({c: F.round(c, 5) for c in out.columns if c.endswith(("_mean", "_std"))})

    plain = rows_of(build(), "transaction_id")
    settings(velocity.RANGE_FRAME_ROWS_CONF, 5)
    settings(MAX_GROUP_ROWS_CONF, 20)
    assert rows_of(build(), "transaction_id") == plain


def test_quantiles_equal_numpy_when_split(spark, settings):
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    values = [r[0] for r in skewed(spark).select("amount").collect()]
    want = np.percentile(values, [100 * p for p in probs])
    settings(MAX_GROUP_ROWS_CONF, 20)
    got = exact_quantiles(skewed(spark), "amount", probs).first()["quantiles"]
    assert np.allclose(got, want)


def test_quantiles_ignore_null_and_nan(spark, settings):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).first()["quantiles"] == [2.0]
    settings(MAX_GROUP_ROWS_CONF, 1)
    assert exact_quantiles(df, "v", [0.5]).first()["quantiles"] == [2.0]


def test_results_do_not_depend_on_partitioning(spark, small_groups):
    def ranks(parts):
        return rows_of(group_rank(skewed(spark).repartition(parts), [], ["amount", "transaction_id"]), "transaction_id")

    assert ranks(1) == ranks(8)


def test_first_by_hash_is_exact(spark, small_groups):
    df = skewed(spark)
    counts = key_counts(df, "sender_account")
    taken = first_by_hash(df, "sender_account", "transaction_id", 5, {0: 77, 1: 3, 2: 10_000}, counts)
    sizes = key_counts(taken, "sender_account")
    assert sizes == {0: 77, 1: 3, 2: counts[2]}


def test_history_counts_equal_rows_at_part_borders(spark, settings):
    rows = skewed(spark, 60).filter("sender_account = 0")
    twice = rows.unionByName(rows)
    settings(PART_ROWS_CONF, 3)
    plain, split = both_ways(spark, settings, lambda: sequence.history_features(twice), "transaction_id", "hours_since_prev")
    assert plain == split
