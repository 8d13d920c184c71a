"""The learner on planted words, the risk against its formula, and held-out accuracy on the benchmark table."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from txrisk.llm import toxicity as tx
from txrisk.llm.queries import op12

LABELS = "doc_id long, toxic int, quality int, text string, terms string"


def labels_frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "x") for d, t in rows], LABELS)


@pytest.fixture(scope="module")
def planted(spark, make_docs, words):
    """600 texts, a sixth of them with two of four bad words; every second bad one and some others are labelled."""
    rng = random.Random(9)
    docs, labels, bad_ids = [], [], set()
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 6 == 0:
            bad_ids.add(i)
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zounds", "zkaputt", "zkaputtest", "zugly"]))
        docs.append((i, " ".join(text).capitalize()))
        if i % 12 == 0 or i % 5 == 1:
            labels.append((i, int(i % 6 == 0)))
    return make_docs(docs), labels_frame(spark, labels), bad_ids


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_planted_words_are_found_without_negative_labels(planted):
    docs, labels, bad = planted
    positives = labels.where("toxic = 1")
    model = tx.fit_toxicity(docs, positives, tx.PositiveUnlabelled(prior=1 / 6))
    rows = tx.score_toxicity(docs, model).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows) and len(rows) == 600
    predicted = {r.doc_id: r.predicted for r in rows}
    assert np.mean([predicted[i] for i in bad]) > 0.9
    assert np.mean([predicted[i] for i in predicted if i not in bad]) < 0.02
    assert {"zounds|", "zugly|"} <= set(model.weights)


def test_held_out_labels_are_not_learned(planted):
    docs, labels, _ = planted
    p = tx.PositiveUnlabelled(least_g=10.0)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    one, other = tx.fit_toxicity(docs, labels, p), tx.fit_toxicity(docs, flipped, p)
    assert one.weights == pytest.approx(other.weights) and one.bias == pytest.approx(other.bias)


def test_risk_is_the_formula_and_never_counts_below_zero():
    rng = np.random.default_rng(2)
    known, other, prior = rng.normal(1, 2, 30), rng.normal(-1, 2, 80), 0.2

    def softplus(z):
        return np.log(1 + np.exp(z))

    part, slope_k, slope_u = tx.risk_and_slopes(known, other, prior)
    assert part == pytest.approx(softplus(other).mean() - prior * softplus(known).mean()) and part > 0

    def risk(k, u):
        return prior * softplus(-k).mean() + softplus(u).mean() - prior * softplus(k).mean()

    for i in (0, 7):
        step = np.eye(len(known))[i] * 1e-6
        assert slope_k[i] == pytest.approx((risk(known + step, other) - risk(known - step, other)) / 2e-6, abs=1e-6)
        step = np.eye(len(other))[i] * 1e-6
        assert slope_u[i] == pytest.approx((risk(known, other + step) - risk(known, other - step)) / 2e-6, abs=1e-6)
    part, slope_k, slope_u = tx.risk_and_slopes(known + 40, other - 40, prior)
    # Overfitted: the step raises the negative part again.
    assert part < 0 and (slope_k > 0).all() and (slope_u < 0).all()


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = labels_frame(spark, [(6, 1), (6, 0), (None, 1), (7, None), (9, 0), (11, 1), (10, 7)])
    rows = tx.score_toxicity(docs, tx.fit_toxicity(docs, labels)).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]


def test_without_labels_or_documents(spark, make_docs):
    docs, none = make_docs([(1, "some words"), (2, None)]), labels_frame(spark, [])
    assert all(r.score < 1e-6 for r in tx.score_toxicity(docs, tx.fit_toxicity(docs, none)).collect())
    only = tx.fit_toxicity(docs, labels_frame(spark, [(1, 1), (2, 1)]))
    assert all(r.predicted == 1 for r in tx.score_toxicity(docs, only).collect())
    assert tx.score_toxicity(make_docs([]), tx.fit_toxicity(make_docs([]), none)).collect() == []


def test_score_is_the_sum_over_terms(spark, make_docs):
    model = tx.ToxicityModel(-1.0, {"abcd": 0.5, "abcdefgh|": 2.0, "xyz|": -1.0})
    text = "Abcdefgh abcdx, xyz xyz other"
    got = tx.score_toxicity(make_docs([(1, text)]), model).first().score
    logit = -1 + 0.5 * np.log1p(40) + 2 * np.log1p(20) - np.log1p(40)
    assert got == pytest.approx(1 / (1 + np.exp(-logit)))


def test_held_out_accuracy(spark):
    """On 825 held-out labelled texts, of which some 6 % have labels that no word of theirs explains."""
    d = "/root/testdata/sf0.1"
    scored = op12(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    toxic = scored.toxic == 1
    assert scored.predicted[toxic].mean() > 0.85
    assert scored.predicted[~toxic].mean() < 0.02
    ranks = scored.score.rank()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93
