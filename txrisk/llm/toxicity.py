"""Toxicity scores learned from confirmed toxic texts and unlabelled ones.

Nothing is taken as proven harmless: the unlabelled texts are a mixture, of which the class prior says how much is
toxic. The risk of a linear classifier is ``prior * E_toxic[loss(+)] + max(0, E_any[loss(-)] - prior * E_toxic[loss(-)])``;
where the estimate of the second part falls below zero on a batch, the step undoes the overfit instead (non-negative
positive-unlabelled learning). Several numpy classifiers learn side by side in Spark tasks from different unlabelled
texts, and their logits are averaged.

What they see is how often a text uses certain words, whole or by their beginnings: those that a G-test finds in far
more confirmed than unlabelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txrisk.llm.batches import small_batches
from txrisk.session import scratch_path

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are terms; a whole word is a term with END behind it.
SHORTEST, LONGEST = 4, 8
END = "|"
#: Texts of the fitted sample whose terms a task holds together.
TEXTS_AT_ONCE = 50
_SAMPLE = "doc_id long, is_toxic boolean, terms array<string>, rates array<double>"


@dataclass(frozen=True)
class PositiveUnlabelled:
    """At most ``max_toxic`` confirmed and ``max_unlabelled`` unlabelled texts are fitted, those of the smallest hash.

    The prior is the share of toxic ones among the labels that may be learned from, unless it is given.
    """

    prior: float | None = None
    max_toxic: int = 4_000
    max_unlabelled: int = 16_000
    max_terms: int = 2_000
    least_texts: int = 3
    least_g: float = 25.0
    members: int = 4
    steps: int = 300
    known_per_step: int = 128
    other_per_step: int = 512
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Logit = bias + sum of a term's weight times log(1 + its uses in a hundred words)."""

    bias: float
    weights: dict[str, float]


def words_of(text: str | None) -> Counter:
    """Words of the whole text, letters of any script in lower case, with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def _terms(word: str) -> list[str]:
    return [word + END] + [word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]


def term_rates(text: str | None, known: set[str] | None = None, heads: set[str] | None = None) -> dict[str, float]:
    """log(1 + uses in a hundred words) of every term, or of the known ones, of a text."""
    counts = words_of(text)
    uses: Counter = Counter()
    for word, n in counts.items():
        if heads is None or word[:SHORTEST] in heads:
            for term in _terms(word):
                if known is None or term in known:
                    uses[term] += n
    total = max(sum(counts.values()), 1)
    return {t: float(np.log1p(100.0 * n / total)) for t, n in uses.items()}


def _heads(terms: dict | set) -> set[str]:
    """The first letters of words that can have one of the terms."""
    return {t.removesuffix(END)[:SHORTEST] for t in terms}


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 0 on division by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def risk_and_slopes(known: np.ndarray, other: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The harmless part of the risk and the slopes of the step by each logit.

    Logistic loss: its slope is q - 1 for a text called toxic and q for one called harmless. A negative part counts as
    zero in the risk, and the step goes up its gradient.
    """
    qk, qu = _sigmoid(known), _sigmoid(other)
    harmless = float(np.logaddexp(0, other).mean() - prior * np.logaddexp(0, known).mean())
    slope_k, slope_u = -prior * qk / len(qk), qu / len(qu)
    if harmless < 0:
        return harmless, -slope_k, -slope_u
    return harmless, slope_k + prior * (qk - 1) / len(qk), slope_u


def fit_member(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, terms: int, prior: float, p: PositiveUnlabelled, seed: int) -> tuple[float, np.ndarray]:
    """(bias, weights) of one classifier by Adam on the non-negative risk; a text is (term numbers, values)."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0.0], np.zeros(terms)])
    at[0] = np.log(prior / (1 - prior))
    moment, square = np.zeros(terms + 1), np.zeros(terms + 1)
    known, other = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    for step in range(1, p.steps + 1):
        some = rng.choice(known, min(p.known_per_step, len(known)), replace=False)
        any_ = rng.choice(other, min(p.other_per_step, len(other)), replace=False)
        rows = [texts[i] for i in (*some, *any_)]
        lengths = np.array([len(r[0]) for r in rows])
        place, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), lengths)
        z = at[0] + np.bincount(row, at[1 + place] * value, len(rows))
        _, slope_k, slope_u = risk_and_slopes(z[: len(some)], z[len(some) :], prior)
        slope = np.concatenate([slope_k, slope_u])
        gradient = np.append(slope.sum(), np.bincount(place, slope[row] * value, terms) + p.decay * at[1:])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        at = at - p.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return float(at[0]), at[1:]


def _sample(documents: DataFrame, usable: DataFrame, p: PositiveUnlabelled) -> DataFrame:
    """doc_id, is_toxic, terms and their rates, of the distinct texts to fit."""
    first = [F.xxhash64("doc_id", F.lit(p.seed)), "doc_id"]
    known = usable.where("toxic = 1").orderBy(*first).limit(p.max_toxic).select("doc_id", F.lit(True).alias("is_toxic"))
    ids = documents.select("doc_id").where("doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = ids.join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    other = ids.orderBy(*first).limit(p.max_unlabelled).select("doc_id", F.lit(False).alias("is_toxic"))
    # Both samples are bounded by the parameters.
    chosen = documents.select("doc_id", "text").join(F.broadcast(known.unionByName(other)), "doc_id")
    once = chosen.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(
        F.min("doc_id").alias("doc_id"), F.max("is_toxic").alias("is_toxic"), F.any_value("text").alias("text")
    )

    schema = to_arrow_schema(StructType.fromDDL(_SAMPLE))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(start, TEXTS_AT_ONCE)
                found = [term_rates(t.as_py()) for t in b.column("text")]
                ends = np.cumsum([0] + [len(f) for f in found])
                terms = pa.array([t for f in found for t in f], pa.string())
                rate = pa.array([r for f in found for r in f.values()], pa.float64())
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (terms, rate)]
                cells = [b.column("doc_id"), b.column("is_toxic"), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema)], schema=schema)

    small_batches(documents.sparkSession)
    return once.select(F.col("doc_id").cast("long").alias("doc_id"), "is_toxic", "text").mapInArrow(rates, _SAMPLE)


def _telling(sample: DataFrame, toxic: int, other: int, p: PositiveUnlabelled) -> list[str]:
    """Terms in more confirmed than other texts, by the G statistic of their two-by-two table; bounded in number."""
    terms = sample.select("is_toxic", F.explode("terms").alias("term"))
    counts = terms.groupBy("term").agg(F.count_if("is_toxic").alias("k"), F.count_if(~F.col("is_toxic")).alias("u"))
    k, u, a, b = F.col("k"), F.col("u"), F.lit(float(toxic)), F.lit(float(other))
    both = (k + u) / (a + b)

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)

    g = 2 * (part(k, a * both) + part(u, b * both) + part(a - k, a * (1 - both)) + part(b - u, b * (1 - both)))
    found = counts.where(k >= p.least_texts).where(k * b > u * a).withColumn("g", g).where(F.col("g") >= p.least_g)
    return [r["term"] for r in found.orderBy(F.desc("g"), "term").limit(p.max_terms).select("term").collect()]


def fit_toxicity(documents: DataFrame, labels: DataFrame, params: PositiveUnlabelled | None = None) -> ToxicityModel:
    """Fit on ``labels(doc_id, toxic)`` joined to ``documents(doc_id, text)``, without held-out rows.

    Of a label only "confirmed toxic" is used, besides the prior. Rows with a null id or label are left out; an id with
    both labels is toxic; equal texts are one text. Without a confirmed toxic text, or without any other, or without
    telling terms, the model scores the prior everywhere, and about 0 if there are no labels.
    """
    p = params or PositiveUnlabelled()
    spark = documents.sparkSession
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = p.prior if p.prior is not None else usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-9), 0.95)
    flat = ToxicityModel(float(np.log(prior / (1 - prior))), {})
    path = scratch_path(spark, "toxicity-sample")
    _sample(documents, usable, p).write.parquet(path)
    sample = spark.read.parquet(path)
    seen = {r["is_toxic"]: r["count"] for r in sample.groupBy("is_toxic").count().collect()}
    if len(seen) < 2:
        return flat
    terms = _telling(sample, seen[True], seen[False], p)
    if not terms:
        return flat
    number = {t: i for i, t in enumerate(terms)}
    members = p.members

    @F.pandas_udf("at array<int>, value array<double>")
    def picked(terms: pd.Series, rates: pd.Series) -> pd.DataFrame:
        kept = [sorted((number[t], v) for t, v in zip(ts, vs) if t in number) for ts, vs in zip(terms, rates)]
        return pd.DataFrame({"at": [[a for a, _ in r] for r in kept], "value": [[v for _, v in r] for r in kept]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        texts = [(np.asarray(a, dtype=np.int64), np.asarray(v, dtype=float)) for a, v in zip(rows["at"], rows["value"])]
        toxic = rows["is_toxic"].to_numpy(dtype=bool)
        if toxic.all():
            return pd.DataFrame({"bias": [], "weights": []})
        bias, weights = fit_member(texts, toxic, len(number), prior, p, p.seed + int(rows["member"].iloc[0]))
        return pd.DataFrame({"bias": [bias], "weights": [weights]})

    every = F.sequence(F.lit(0), F.lit(members - 1))
    mine = F.array(F.pmod(F.xxhash64("doc_id"), F.lit(members)).cast("int"))
    small = sample.select("doc_id", "is_toxic", picked("terms", "rates").alias("picked")).select("doc_id", "is_toxic", "picked.*")
    dealt = small.withColumn("member", F.explode(F.when(F.col("is_toxic"), every).otherwise(mine)))
    # A row per member, of as many numbers as there are terms.
    rows = dealt.groupBy("member").applyInPandas(learn, "bias double, weights array<double>").collect()
    weights = np.mean([r["weights"] for r in rows], axis=0)
    return ToxicityModel(float(np.mean([r["bias"] for r in rows])), dict(zip(terms, map(float, weights))))


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents(doc_id, text, ...)``.

    The whole text counts. A null or empty text has the score of the model's bias, repeated rows score alike, rows
    without a doc_id are scored and not held out, and other columns are never inputs.
    """
    small_batches(documents.sparkSession)
    bias, weights = model.bias, model.weights
    known, heads = set(weights), _heads(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            logits = [bias + sum(weights[t] * v for t, v in sorted(term_rates(text, known, heads).items())) for text in texts]
            yield pd.Series(_sigmoid(np.array(logits, dtype=float)))

    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
