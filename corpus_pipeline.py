"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Every stage is a function of (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of the documents. A stage's result is written and read back before the next one, so each starts from
files and a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txrisk.llm.decontamination import drop_contaminated
from txrisk.llm.exact_dedup import keep_one_of_equal
from txrisk.llm.near_dedup import NearDedup, keep_one_per_component
from txrisk.llm.packing import pack
from txrisk.llm.quality_rules import fit_rules, keep_good
from txrisk.plans.registry import query
from txrisk.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; an empty table stays empty."""
    return keep_good(docs, fit_rules(docs, _table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, the largest doc_id."""
    return keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near copies (five-word shingles, similarity 0.8), the smallest doc_id."""
    return keep_one_per_component(docs, NearDedup(shingle_words=5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left, one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
