from __future__ import annotations

import pytest

from txrisk.sources import files, synthetic


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id int, name string, v double")


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_round_trip_by_suffix(spark, tmp_path, table, fmt):
    path = str(tmp_path / f"t.{fmt}")
    files.sink_table(table, path, fmt)
    back = files.scan_table(spark, path, schema=table.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_unknown_suffix_is_sniffed(spark, tmp_path, table, fmt):
    path = str(tmp_path / "t.data")
    files.sink_table(table, path, fmt)
    assert set(files.scan_table(spark, path).columns) == {"id", "name", "v"}


def test_unsupported_format(spark, table, tmp_path):
    with pytest.raises(ValueError):
        files.scan_table(spark, "x", "xml")
    with pytest.raises(ValueError):
        files.sink_table(table, str(tmp_path / "x"), "xml")


def test_metrics_are_json(spark, tmp_path):
    path = str(tmp_path / "m")
    files.sink_metrics(files.metrics_table(spark, {"auc": 0.5}), path)
    assert spark.read.json(path).first()["value"] == 0.5


def test_synthetic_rows_are_reproducible(spark):
    a, b = synthetic.synthetic_transactions(spark, 500), synthetic.synthetic_transactions(spark, 500).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.filter("amount < 0 or amount >= 10000").count() == 0
    assert 5 < a.filter("is_fraud").count() < 60
