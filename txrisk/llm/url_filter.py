"""URL filter: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules are one expression over every row, more are a joined table.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class UrlModel:
    """Parameters of the n-gram model; at most ``max_labelled`` labelled urls are fitted."""

    shortest: int = 3
    longest: int = 5
    features: int = 1 << 15
    regularisation: float = 1e-3
    iterations: int = 40
    max_labelled: int = 20_000


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: list[Rule]) -> list[Rule]:
    """The first fitting rule decides: longest first."""
    return sorted(set(rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.path, r.verdict))


def with_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows(host, path, ...)`` with ``fits``, the rule that decides.

    Many rules are joined: every host meets the rules of itself and of the domains above it by equality, and the rule
    that decides comes back per distinct (host, path).
    """
    if len(rules) <= MAX_RULES:
        return rows.withColumn("fits", matching_rule(rules, F.col("host"), F.col("path")))
    numbered = [(r.host, r.path, r.verdict, i) for i, r in enumerate(_ordered(rules))]
    table = rows.sparkSession.createDataFrame(numbered, "rule_host string, rule_path string, verdict string, place long")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.withColumn("rule_host", F.explode(above)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    told = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    decided = met.groupBy("host", "path").agg(F.min_by(told, "place").alias("fits"))
    return rows.join(decided, ["host", "path"], "left")


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null when none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = _ordered(rules)
    table = F.array(
        *(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in ordered)
    )
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]),
    )
    first = F.get(fits, F.lit(0))
    return F.when(
        first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict"))
    )


def _grams(mark: str, text: Column, n: int) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(framed) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))


def url_grams(host: Column, path: Column, p: UrlModel) -> Column:
    """Marked n-grams of the host and of the path."""
    sizes = range(p.shortest, p.longest + 1)
    return F.concat(*(_grams(f"{mark}{n}:", text, n) for mark, text in (("h", host), ("p", path)) for n in sizes))


def fit_url_model(labelled: DataFrame, params: UrlModel | None = None) -> PipelineModel | str:
    """Fit on ``labelled(url, verdict)`` (allow or block; other rows are left out).

    Of the distinct labelled urls the ``max_labelled`` with the smallest hash are used. A table with one verdict
    only gives that verdict for every url, an empty one ``allow``.
    """
    p = params or UrlModel()
    rows = (
        labelled.select("url", "verdict")
        .where("url is not null and verdict in ('allow', 'block')")
        .distinct()
        .orderBy(F.xxhash64("url"), "url", "verdict")
        .limit(p.max_labelled)
        .select(
            url_grams(url_host(F.col("url")), url_path(F.col("url")), p).alias("grams"),
            (F.col("verdict") == "block").cast("double").alias("label"),
        )
        .cache()
    )
    seen = sorted(r[0] for r in rows.select("label").distinct().collect())
    if len(seen) < 2:
        rows.unpersist()
        return "block" if seen == [1.0] else "allow"
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=p.features, binary=True),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=p.regularisation, maxIter=p.iterations),
    ]
    model = Pipeline(stages=stages).fit(rows)
    rows.unpersist()
    return model


def judge_urls(pages: DataFrame, rules: list[Rule], model: PipelineModel | str, params: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages(page_id, url, ...)``.

    A fitting rule decides; else the model does (``block`` from a score of 0.5). A null url or one without
    ``://`` has an empty host and path and is judged by the model. Repeated rows are judged alike; other
    columns are ignored. The score is the model's probability of ``block``, also where a rule decides.
    """
    p = params or UrlModel()
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = with_rules(rows, rules)
    if isinstance(model, str):
        scored = rows.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(rows.withColumn("grams", url_grams(F.col("host"), F.col("path"), p)))
        scored = scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", learned).alias("verdict"), "score"
    )
