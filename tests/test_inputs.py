"""Inputs as they come: other column orders, arrays of records, NaN, extreme values, many categories, no rows."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from txrisk.operators import evaluation, explore, hashing, prep, velocity
from txrisk.schema import TRANSACTION
from txrisk.sources import files


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "is_fraud,amount,transaction_id,timestamp,more\n1,2.5,a,2024-01-02 03:04:05,x\n0,,b,not a time,y\nTrue,7,c,2024-01-02,z\n"
    )
    got = files.scan_csv(spark, str(path))
    assert got.schema == TRANSACTION
    rows = {r.transaction_id: (r.amount, r.is_fraud, r.timestamp is None, r.velocity_score) for r in got.collect()}
    assert rows == {"a": (2.5, True, False, None), "b": (None, False, True, None), "c": (7.0, True, False, None)}
    path.write_text("amount\n1\n")
    with pytest.raises(ValueError, match="transaction_id"):
        files.scan_csv(spark, str(path)).collect()


@pytest.mark.parametrize("name", ["t.json", "records"])
def test_json_arrays_and_lines(spark, tmp_path, name):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    for text in (json.dumps(records, indent=2), "\n".join(map(json.dumps, records))):
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, files.scan_table(spark, str(tmp_path / name)).collect())) == [(1, "x"), (2, "y")]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.0, 1), (float("nan"), 1.0, 1), (4.0, 8.0, 0)], "x double, y double, l int")
    assert [(r.column_name, r.missing) for r in explore.missing_summary(df).collect()] == [("x", 1)]
    corr = {(r.a, r.b): r["corr"] for r in explore.correlation_matrix(df, ["x", "y"]).collect()}
    assert math.isclose(corr["x", "y"], 1.0)
    assert {r.l: (r.n, r.max) for r in explore.describe_by_label(df, "x", "l").collect()} == {0: (2, 4.0), 1: (1, 2.0)}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e15])
def test_sums_do_not_depend_on_the_size_of_an_entity(spark, settings, scale):
    rows = [(i, "a", i * 3600, scale * (i % 7 + 0.1) if i % 5 else None) for i in range(60)] + [(99, "a", 7200, float("nan"))]
    df = spark.createDataFrame(rows, "id int, e string, s long, v double").withColumn("t", F.timestamp_seconds("s")).drop("s")

    def run():
        a = velocity.velocity_features(df, "e", "t", "id", "v", [1])
        b = velocity.rolling_time_aggs(df, "e", "v", "t", [1])
        return [{r.id: r for r in x.collect()} for x in (a, b)]

    plain = run()
    settings(velocity.RANGE_FRAME_ROWS_CONF, 2)
    for one, other in zip(plain, run()):
        for i, r in one.items():
            for name, x in r.asDict().items():
                y = other[i][name]
                same = x == y or (isinstance(x, float) and (x != x and y != y or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6 * scale)))
                assert same, (name, i, x, y)


def test_rolling_features_read_the_source_a_few_times(spark, settings):
    rows = [(i, "a" if i < 30 else f"k{i}", f"g{i % 9}", i * 60, float(i), float(i * i), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, e string, g string, s long, x double, y double, z double").withColumn("t", F.timestamp_seconds("s"))
    settings(velocity.RANGE_FRAME_ROWS_CONF, 5)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    out = velocity.rolling_features(df.mapInPandas(counted, df.schema), ["e", "g"], ["x", "y", "z"], "t", [1])
    assert out.count() == 60 and {f"{g}_{v}_1d_mean" for g in "eg" for v in "xyz"} <= set(out.columns)
    assert reads.value <= 2 * 4 * 60


def test_splits_over_many_strata(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 4000).alias("stratum"))
    got = prep.split_stratified(df, "stratum", "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"test": 4000, "val": 4000, "train": 12_000}


def test_splits_over_more_strata_than_a_driver_should_hold(spark):
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 150_000).alias("stratum"))
    got = prep.split_stratified(df, "stratum", "id")
    assert got.columns == ["id", "stratum", "split"] and got.count() == 300_000
    without = {r.split: r["count"] for r in got.where("stratum IS NULL").groupBy("split").count().collect()}
    assert without == {"test": 20_000, "val": 20_000, "train": 60_000}


@pytest.mark.parametrize("rows", [20, 2_000_000])
def test_splits_by_rank_equal_splits_by_cut(spark, settings, monkeypatch, rows):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 10).alias("stratum"))
    cut = prep.split_stratified(df, "stratum", "id").collect()
    monkeypatch.setattr(hashing, "LITERAL_KEYS", 2)
    settings("spark.txrisk.maxGroupRows", rows)
    assert sorted(prep.split_stratified(df, "stratum", "id").collect()) == sorted(cut)


def test_a_grid_without_rows(spark):
    df = spark.createDataFrame([], "score double, label int")
    got = evaluation.threshold_counts(df, "score", "label", [0.1, 0.5]).collect()
    assert sorted((r.threshold, r.tp, r.fp, r.fn, r.tn) for r in got) == [(0.1, 0, 0, 0, 0), (0.5, 0, 0, 0, 0)]
