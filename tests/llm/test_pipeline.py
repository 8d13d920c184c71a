from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from txrisk.llm.near_dedup import NearDedup, near_components
from txrisk.llm.quality_rules import fit_rules, score_quality

SMALL = "/root/testdata/sf0.001"
NUMBERED = [
    "op1_url_filter",
    "op2_license_scan",
    "op3_line_dedup",
    "op4_suffix_dedup",
    "op5_token_counts",
    "op6_packing",
    "op7_minhash_near_dedup",
    "op8_exact_dedup",
    "op9_benchmark_decontamination",
    "op10_quality_classifier",
]


def test_every_operator_and_the_pipeline_are_registered():
    assert {*NUMBERED, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in NUMBERED if n in __spark_entry__.oracle_sql()])
def test_queries_equal_sql(spark, name):
    from tools.check_oracles import compare, connect
    from txrisk.plans.registry import QUERIES

    assert compare(spark, connect(SMALL), QUERIES[name], SMALL) is None


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before, docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {name: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for name, (a, b) in seen.items()}
    scored = score_quality(seen["quality"][0], fit_rules(seen["quality"][0], spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert ids["quality"][1] == {r.doc_id for r in scored.where("predicted = 1").collect()}
    last = {}
    for r in seen["exact"][0].collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert ids["exact"][1] == set(last.values())
    assert ids["near"][1] == {r.doc_id for r in near_components(seen["near"][0], NearDedup()).where("kept").collect()}
    assert ids["decontaminate"][1] <= ids["near"][1]
    assert ids["packing"][1] == ids["decontaminate"][1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL).collect() == []
