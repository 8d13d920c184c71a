"""Mining against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import hard_negatives as hn

SMALL = hn.HyperplaneTree(arity=4, leaf_rows=20, block_rows=16, sample=64, max_leaves=40, queries_at_once=3)
TABLE = "vec_id long, label int, embedding array<float>, id long, v string, leaf int, `key` long, windows string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 1, "x") for r in rows], TABLE)


def brute(rows, is_anchor):
    def whole(v):
        return [math.floor(max(min(float(np.float32(x)) * 256, 2**27), -(2**27))) for x in v]

    usable = [(i, lab, whole(v)) for i, lab, v in rows
              if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in sorted({(i, lab, tuple(v)) for i, lab, v in usable if is_anchor(i)}):
        scored = [(sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in usable if i != a]
        best = sorted(((s, i) for s, i, lab in scored if lab == label), key=lambda r: (-r[0], r[1]))[:5]
        for p, pid in best:
            near = sorted(((s, i) for s, i, lab in scored if lab != label and 30 * p <= 100 * s <= 90 * p), key=lambda r: (-r[0], r[1]))
            out += [(a, pid, k + 1, n, p, s) for k, (s, n) in enumerate(near[:10])]
    return sorted(out)


def mined(spark, rows, params=SMALL):
    usable = hn.usable_rows(frame(spark, rows))
    return sorted(map(tuple, hn.mine_negatives(usable, F.col("id") % 10 == 0, params=params).collect()))


def vectors(seed, n, width=6, clusters=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [(i, rng.randrange(3), [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


def tens(i):
    return i % 10 == 0


def test_equals_all_pairs(spark):
    rows = vectors(1, 300)
    assert mined(spark, rows) == brute(rows, tens) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60) + [
        (None, 1, [1.0] * 6), (100, None, [1.0] * 6), (101, 1, None), (110, 1, [nan] * 6), (111, 1, [inf] * 6),
        (112, 1, [None] * 6), (113, 1, []), (114, 1, [0.5]), (120, 2, [0.5] * 9), (5, 1, [0.7] * 6), (5, 1, [0.7] * 6),
        (20, 0, [0.4] * 6), (130, 1, [-3e9] * 6), (131, 1, [3e38] * 6), (140, 0, [0.0] * 6),
    ]
    assert mined(spark, rows) == brute(rows, tens)


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = vectors(3, 120) + [(1000 + i, i % 2, [0.25] * 6) for i in range(60)]
    assert mined(spark, rows) == brute(rows, tens)


def test_repeated_rows(spark):
    rows = vectors(4, 40) * 2
    got, want = mined(spark, rows), brute(rows, tens)
    assert got == want


def test_same_rows_from_a_coarse_tree(spark):
    rows = vectors(6, 200)
    assert mined(spark, rows) == mined(spark, rows, hn.HyperplaneTree())


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(10, 1, [1.0])], [(10, 1, [1.0]), (11, 2, [1.0])]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows) == []


def test_siblings_are_ruled_out_and_none_wrongly():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (12, 8))
    x = np.floor(centres[rng.integers(0, 12, 2000)] + rng.normal(0, 20, (2000, 8))).astype(np.int64)
    longest = float((x * x).sum(axis=1).max())
    tree = hn.build_tree(x[:500], len(x), longest, hn.HyperplaneTree(arity=4, leaf_rows=100, sample=500, max_leaves=60))
    lifted = hn._lift(x, longest)
    for n in tree:
        n.low, n.high = np.full((len(n.children), len(n.points)), np.inf), np.full((len(n.children), len(n.points)), -np.inf)
    for node, _, far, child in hn._descend(tree, lifted):
        np.minimum.at(tree[node].low, child, far)
        np.maximum.at(tree[node].high, child, far)
    leaf = hn._leaf_of(tree, lifted)
    visited = 0
    for q in x[:40]:
        s = x @ q
        top = int(np.sort(s)[-20])
        for lo, hi in [(top, 2**62), (top // 2, top)]:
            to = hn.reached(tree, q.astype(float), longest, [(lo, hi)])
            assert set(leaf[(s >= lo) & (s <= hi)]) <= set(to)
        visited += len(hn.reached(tree, q.astype(float), longest, [(top, 2**62)]))
    assert visited < 0.5 * 40 * (leaf.max() + 1)
