"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow random-forest trees are fitted to labelled texts; every path from a root becomes a rule, a conjunction of
bounds on statistics. A logistic regression with an L1 penalty weighs the rules, and those with a weight are
compiled into one Spark column expression, which scores any number of texts without a model object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from txrisk.llm.batches import small_batches
from txrisk.llm.columns import fresh
from txrisk.session import ensure_checkpoint_dir

STATISTICS = [
    "log_bytes",
    "log_words",
    "word_bytes",
    "longest_word",
    "short_words",
    "upper",
    "digits",
    "symbols",
    "stops",
    "commas",
    "non_ascii",
    "lines_per_word",
    "repeated_lines",
    "repeated_words",
    "marked_words",
    "upper_words",
]


@dataclass(frozen=True)
class RuleEnsemble:
    """At most ``max_labelled`` labelled rows are fitted, those with the smallest hash of their id."""

    trees: int = 20
    depth: int = 3
    penalty: float = 5e-4
    max_labelled: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_above, bound) hold; the weight adds to the score's logit."""

    bounds: tuple[tuple[int, bool, float], ...]
    weight: float

    def holds(self, statistics: Column) -> Column:
        out = F.lit(True)
        for at, above, bound in self.bounds:
            value = statistics[STATISTICS[at]]
            out = out & ((value > bound) if above else (value <= bound))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, statistics: Column) -> Column:
        """Probability of label 1; the logit is a sum over an array, so the expression stays shallow."""
        weights = [F.when(r.holds(statistics), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules]
        logit = F.aggregate(F.array(*weights), F.lit(self.intercept), lambda a, w: a + w) if weights else F.lit(self.intercept)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    letter = upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    digit = (code >= 48) & (code <= 57)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    stop, comma = np.isin(code, list(b".?!")), np.isin(code, list(b",;:'\"()-"))
    symbol = ~(letter | digit | space | np.isin(code, list(b".?")) | comma)
    return {"upper": upper, "digits": digit, "symbols": symbol, "stops": stop, "commas": comma, "non_ascii": code >= 128, "letters": letter, "space": space}


_CLASS = _classes()


def text_statistics(text: str | None) -> list[float]:
    """The values of STATISTICS; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line]
    if not words:
        return [float(np.log2(len(raw) + 1))] + [0.0] * (len(STATISTICS) - 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    of = {k: int(counts[mask].sum()) for k, mask in _CLASS.items()}
    n, letters = len(raw), max(of["letters"], 1)
    # A word's last byte, for words that end in a symbol; its first two, for words in capitals.
    edge = np.flatnonzero(np.diff(~_CLASS["space"][data], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    capital = _CLASS["upper"][data[starts]] & _CLASS["upper"][data[np.minimum(starts + 1, n - 1)]] & (ends - starts > 1)
    return [
        float(np.log2(n + 1)),
        float(np.log2(len(words) + 1)),
        float(lengths.mean()),
        float(np.log2(lengths.max())),
        float((lengths <= 3).mean()),
        of["upper"] / letters,
        of["digits"] / n,
        of["symbols"] / n,
        of["stops"] / len(words),
        of["commas"] / n,
        of["non_ascii"] / n,
        len(lines) / len(words),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(words)) / len(words),
        float(_CLASS["symbols"][data[ends - 1]].mean()),
        float(capital.mean()),
    ]


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in STATISTICS]))
def statistics_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in text], columns=STATISTICS, dtype="float64")


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _paths(tree_text: str) -> set[tuple[tuple[int, bool, float], ...]]:
    """The conditions above every node of a tree, as the library prints it; bounds on one side are merged."""
    found, stack = set(), []
    for line in tree_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        stack = [above for above in stack if above[0] < len(m[1])]
        stack.append((len(m[1]), (int(m[2]), m[3] == ">", float(m[4]))))
        tightest: dict[tuple[int, bool], float] = {}
        for _, (at, above, bound) in stack:
            pick = max if above else min
            tightest[at, above] = pick(tightest.get((at, above), bound), bound)
        found.add(tuple(sorted((at, above, bound) for (at, above), bound in tightest.items())))
    return found


def fit_rules(documents: DataFrame, labels: DataFrame, params: RuleEnsemble | None = None) -> RuleModel:
    """Fit on ``labels(doc_id, quality)`` joined to ``documents(doc_id, text)``, without held-out rows.

    Rows with a null id or label are left out. Without labelled texts the model scores 0.5 everywhere; with one
    label only, that label everywhere.
    """
    p = params or RuleEnsemble()
    ensure_checkpoint_dir(documents.sparkSession)
    small_batches(documents.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = usable.select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(p.max_labelled)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    stats = rows.select("doc_id", "label", statistics_of("text").alias("s")).select("doc_id", "label", "s.*")
    stats = stats.repartition(8, "doc_id").sortWithinPartitions("doc_id", *STATISTICS).checkpoint()
    seen = {r[0]: r[1] for r in stats.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleModel({0.0: -20.0, 1.0: 20.0}.get(next(iter(seen), None), 0.0), ())
    features = stats.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), F.struct(*STATISTICS).alias("s"))
    forest = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, maxBins=64, minInstancesPerNode=5).fit(features)
    bounds = sorted(set().union(*(_paths(tree.toDebugString) for tree in forest.trees)))
    if not bounds:
        return RuleModel(float(np.log(seen[1.0] / seen[0.0])), ())
    indicators = F.array(*(Rule(b, 1.0).holds(F.col("s")).cast("double") for b in bounds))
    fitted = LogisticRegression(featuresCol="rules", regParam=p.penalty, elasticNetParam=1.0, standardization=False, maxIter=60, tol=1e-5).fit(
        features.select("label", array_to_vector(indicators).alias("rules"))
    )
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), tuple(Rule(b, float(w)) for b, w in zip(bounds, weights) if w))


def score_quality(documents: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents(doc_id, text, ...)``.

    A null text is an empty text, whose statistics are zeros. Repeated rows score alike; rows without a doc_id are
    scored and not held out. Other columns are never inputs.
    """
    small_batches(documents.sparkSession)
    scored = documents.select("doc_id", statistics_of("text").alias("s"))
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``documents`` that score 0.5 or more, all columns as they are."""
    small_batches(documents.sparkSession)
    (statistics,) = fresh(documents, "statistics")
    scored = documents.withColumn(statistics, statistics_of("text"))
    return scored.where(model.score(F.col(statistics)) >= 0.5).drop(statistics)
