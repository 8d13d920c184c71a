"""Nearest neighbours against brute force, and what over-sampling promises."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import knn, prep, sampling
from txrisk.session import MAX_BROADCAST_BYTES_CONF


def cloud(spark, n=240, d=6, copies=0, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)).round(3)
    X[: n // 3] += 4.0
    if copies:
        X[-copies:] = X[-1]
    y = (np.arange(n) % 6 == 0).astype(int)
    rows = [(int(i), X[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(3), X, y


def brute(X, queries, k, allowed=None):
    out = {}
    for q in queries:
        d = np.sqrt(((X - X[q]) ** 2).sum(1))
        order = sorted((float(d[i]), i) for i in range(len(X)) if i != q and (allowed is None or allowed[i] == allowed[q]))
        out[q] = [i for _, i in order[:k]]
    return out


def neighbours(pairs):
    got = {}
    for r in pairs.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return got


@pytest.mark.parametrize("copies", [0, 100])
@pytest.mark.parametrize("way", ["broadcast", "cells"])
def test_knn_equals_brute_force(spark, settings, way, copies):
    df, X, y = cloud(spark, copies=copies)
    if way == "cells":
        settings(MAX_BROADCAST_BYTES_CONF, 1)
    pairs = knn.knn_topk(df.filter("label = 1"), df, 5, block_rows=25)
    assert neighbours(pairs) == brute(X, np.nonzero(y)[0].tolist(), 5)


@pytest.mark.parametrize("way", ["broadcast", "cells"])
def test_knn_within_groups(spark, settings, way):
    df, X, _ = cloud(spark, n=90)
    if way == "cells":
        settings(MAX_BROADCAST_BYTES_CONF, 1)
    grouped = df.withColumn("g", (F.col("id") % 3).cast("int"))
    pairs = knn.knn_topk(grouped, grouped, 4, group="g", block_rows=20)
    assert neighbours(pairs) == brute(X, range(90), 4, allowed=np.arange(90) % 3)


def test_knn_bounded_by_a_sample(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE_ABOVE", 10)
    df, X, y = cloud(spark, n=900)
    pairs = knn.knn_topk(df.filter("label = 1"), df, 3)
    assert neighbours(pairs) == brute(X, np.nonzero(y)[0].tolist(), 3)


def test_fewer_rows_than_neighbours(spark):
    df, _, _ = cloud(spark, n=3)
    assert knn.knn_topk(df, df, 5).count() == 6


@pytest.mark.parametrize("technique", ["smote", "borderline_smote", "cluster_smote"])
def test_ratio_is_reached_and_points_lie_between(spark, technique):
    df, X, y = cloud(spark)
    out = sampling.rebalance(df, technique, ratio=0.5)
    n1, n0 = out.filter("label = 1").count(), out.filter("label = 0").count()
    assert n0 == (y == 0).sum() and n1 == int(0.5 * n0)
    for r in out.filter("synthetic").collect():
        a, b = X[r["seed_id"]], X[r["neighbor_id"]]
        assert y[r["seed_id"]] == y[r["neighbor_id"]] == 1 and r["seed_id"] != r["neighbor_id"]
        assert 0 <= r["gap"] < 1
        assert np.allclose(r["features"], a + r["gap"] * (b - a))


def test_smote_is_a_no_op_when_balanced(spark):
    df, _, _ = cloud(spark)
    assert sampling.smote(df, ratio=0.1).filter("synthetic").count() == 0


def test_adasyn_far_minority_is_uniform(spark):
    rows = [(i, [100.0 + i * 0.1], 1) for i in range(6)] + [(10 + i, [float(i)], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    weights = [r["weight"] for r in sampling.adasyn_density(df, k=3).collect()]
    assert np.allclose(weights, 1 / 6)


def test_borderline_zones_by_hand(spark):
    far = [(i, [50.0 + 0.01 * i], 1) for i in range(12)]
    noise = [(100, [0.0], 1)] + [(200 + i, [0.1 + 0.01 * i], 0) for i in range(30)]
    danger = [(300 + i, [20.0 + 0.01 * i], 1) for i in range(4)] + [(400 + i, [20.1 + 0.01 * i], 0) for i in range(8)]
    df = spark.createDataFrame(far + noise + danger, "id long, features array<double>, label int")
    zones = {r["id"]: r["zone"] for r in sampling.borderline_zones(df).collect()}
    assert zones[0] == "safe" and zones[100] == "noise" and zones[300] == "danger"


def test_under_and_over_sampling_sizes(spark):
    df, _, y = cloud(spark)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    under = sampling.undersample(df, "label", "id", 0.5)
    assert under.filter("label = 1").count() == n1 and under.filter("label = 0").count() == 2 * n1
    over = sampling.oversample(df, "label", "id", 1.0)
    assert over.filter("label = 1").count() == over.filter("label = 0").count() == n0


def test_unknown_technique(spark):
    with pytest.raises(ValueError):
        sampling.rebalance(cloud(spark)[0], "magic")


def test_balanced_sample_quotas(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("transaction_id"),
        (F.col("id") % 10 < 3).alias("is_fraud"),
        F.when(F.col("id") % 10 < 3, F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).alias("fraud_type"),
        F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("transaction_type"),
    )
    out = sampling.balanced_sample(rows, "transaction_id", 101)
    assert out.count() == 101 and out.filter("is_fraud").count() == 30
    assert [r["count"] for r in out.filter("is_fraud").groupBy("fraud_type").count().collect()] == [10, 10, 10]
    assert out.select("transaction_id").distinct().count() == 101


def test_balanced_sample_takes_all_when_short_of_fraud(spark):
    rows = spark.range(500).select(
        F.col("id").alias("transaction_id"), (F.col("id") < 7).alias("is_fraud"),
        F.lit("x").alias("fraud_type"), F.lit("t").alias("transaction_type"),
    )
    assert sampling.balanced_sample(rows, "transaction_id", 100).filter("is_fraud").count() == 7


def test_splits_are_disjoint_complete_and_stratified(spark):
    df, _, y = cloud(spark)
    out = prep.split_stratified(df, "label", "id")
    assert out.count() == len(y)
    counts = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    for label, n in ((0, 200), (1, 40)):
        assert counts[("test", label)] == n // 5 and counts[("val", label)] == n // 5
    again = prep.split_stratified(df.repartition(7), "label", "id")
    assert sorted(map(tuple, out.select("id", "split").collect())) == sorted(map(tuple, again.select("id", "split").collect()))


def test_many_copies_of_one_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK", 10)
    df = spark.createDataFrame([(1, 95), (2, 0), (3, 10)], "id long, copies int")
    out = sampling.expand_copies(df.filter("copies > 0"), "copies", 95)
    assert sorted(r["copy"] for r in out.filter("id = 1").collect()) == list(range(1, 96))
    assert sorted(r["copy"] for r in out.filter("id = 3").collect()) == list(range(1, 11))


def clustered(spark, rows=400, kind="long"):
    """Clusters with exact copies in them; every fifth row is of the minority."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, rows)] * 4 + rng.normal(size=(rows, 6))
    x[::17] = x[0]
    name = (lambda i: f"TX{i}") if kind == "string" else (lambda i: i)
    return spark.createDataFrame([(name(i), x[i].tolist(), int(i % 5 == 0)) for i in range(rows)], f"id {kind}, features array<double>, label int")


def brute_force(df, k):
    rows = df.collect()
    out = set()
    for q in rows:
        if q["label"] != 1:
            continue
        near = sorted((float(np.sqrt(((np.array(q["features"]) - np.array(r["features"])) ** 2).sum())), r["id"]) for r in rows if r["id"] != q["id"])
        out |= {(q["id"], r, i + 1) for i, (_, r) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("limit", [None, 0])
def test_neighbours_on_both_paths_with_ids_of_any_type(spark, settings, kind, limit):
    if limit is not None:
        settings(MAX_BROADCAST_BYTES_CONF, limit)
    df = clustered(spark, kind=kind)
    pairs = knn.knn_topk(df.filter("label = 1"), df, 4, block_rows=60)
    assert pairs.schema["query_id"].dataType == df.schema["id"].dataType
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in pairs.collect()} == brute_force(df, 4)


@pytest.mark.parametrize("limit", [None, 0])
def test_nearest_of_every_tag_in_one_search(spark, settings, limit):
    if limit is not None:
        settings(MAX_BROADCAST_BYTES_CONF, limit)
    df = clustered(spark)
    pairs = knn.knn_topk(df.filter("label = 1"), df, 3, tag="label", block_rows=60, per_tag=True)
    alone = knn.knn_topk(df.filter("label = 1"), df.filter("label = 1"), 3)
    assert set(map(tuple, pairs.filter("neighbor_tag = 1").select("query_id", "neighbor_id", "rank").collect())) == set(map(tuple, alone.select("query_id", "neighbor_id", "rank").collect()))
    whole = knn.overall(pairs, 3).select("query_id", "neighbor_id", "rank")
    assert set(map(tuple, whole.collect())) == brute_force(df, 3)


def test_few_exact_comparisons_per_query():
    rng = np.random.default_rng(4)
    rows, queries, k = rng.normal(size=(5000, 32)), rng.normal(size=(50, 32)), 5
    low = rows.min(0)
    width = (rows.max(0) - low) / 256
    code, error = knn.encode(rows, low, width)
    least, most = knn.bounds_of(queries, knn.decode(code, low, width), error)
    true = np.sqrt(((queries[:, None, :] - rows[None, :, :]) ** 2).sum(2))
    assert (least <= true).all() and (true <= most).all()
    ids = np.arange(5000)
    found = knn._candidates(
        ids[:50], -1 - ids[:50], queries, np.zeros(50, "int32"), np.full(50, np.inf), ids, ids, knn.decode(code, low, width),
        np.zeros(5000, "int32"), np.zeros(5000, "int32"), error, k,
    )
    per_query = found.groupby("query_key").size()
    # Vectors without any cluster, of which cells rule out nothing: a handful beyond the k nearest are compared.
    assert len(per_query) == 50 and per_query.max() <= 3 * k
    for q, part in found.groupby("query_key"):
        assert set(np.argsort(true[q])[:k]) <= set(part["key"])


@pytest.mark.parametrize("technique", ["smote", "adasyn", "borderline_smote", "cluster_smote"])
def test_resampling_with_text_ids(spark, technique):
    out = sampling.rebalance(clustered(spark, 200, "string"), technique)
    assert dict(out.dtypes)["seed_id"] == "string" and out.filter("synthetic").filter("seed_id like 'TX%'").count() > 0


def test_lone_minority_row_still_reaches_the_ratio(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], int(i == 7)) for i in range(21)], "id long, features array<double>, label int")
    made = sampling.smote(df, ratio=0.5).filter("synthetic")
    assert made.count() == 9 and made.filter("features[0] = 7.0 and neighbor_id = 7").count() == 9


def test_identical_and_crowded_rows_leave_blocks_as_k_pairs(spark, settings, monkeypatch):
    """Most rows share one vector or lie close together, far off ones widen the range, and ids repeat."""
    settings(MAX_BROADCAST_BYTES_CONF, 0)
    rng = np.random.default_rng(3)
    X = np.concatenate([np.zeros((300, 2)), rng.normal(scale=1e-6, size=(400, 2)), rng.normal(size=(50, 2)) * 1e4])
    ids = [*range(len(X))]
    rows = [(i, x.tolist()) for i, x in zip(ids, X)] + [(5, X[5].tolist()), (720, X[720].tolist())]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    made = []
    monkeypatch.setattr(knn, "stored", lambda t, plain=knn.stored: made.append(plain(t)) or made[-1])
    got = {}
    for r in knn.knn_topk(df, df, 4, block_rows=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    for i in ids:
        near = sorted((float(np.sqrt(((X[i] - np.array(x)) ** 2).sum())), j) for j, x in rows if j != i)[:4]
        times = 2 if i in (5, 720) else 1
        assert sorted(got[i]) == sorted([(n + 1, j) for n, (_, j) in enumerate(near)] * times), i
    # Some 750 queries and 4 neighbours: what is written grows with their number alone.
    assert max(n for _, n in made) <= 4 * 752


def test_tree_reaches_all_near_leaves():
    rng = np.random.default_rng(9)
    X = np.concatenate([rng.normal(size=(2000, 3)), np.tile([[1.0, 2.0, 3.0]], (500, 1))])
    none = np.zeros(len(X), int)
    forest = knn.grow(none, none, X, 16)
    home = forest.leaf_of(none, none, X)
    assert home.min() == 0 and home.max() == forest.leaves - 1 and len(np.unique(home)) == forest.leaves
    reach = np.full(20, 0.3)
    query, leaf = forest.leaves_near(none[:20], none[:20], X[:20], reach)
    for i in range(20):
        within = np.sqrt(((X - X[i]) ** 2).sum(1)) <= 0.3
        assert set(home[within]) <= set(leaf[query == i])
    assert (forest.leaf_of(none + 1, none, X) == -1).all()
