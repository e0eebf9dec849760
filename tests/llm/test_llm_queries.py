import re

import pytest

import corpus_pipeline
from compare import connect, mismatch
from rillmeter.llm.queries import ORACLES, QUERIES

INSULTS = set("idiot moron clown trash disgusting scum loser worthless stupid pathetic".split())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir):
    assert mismatch(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_pipeline_stages(spark, sf_dir):
    from brute import brute_stages

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if k < 4:
            assert docs.columns == columns, name
            after = [tuple(r) for r in docs.collect()]
            kept = sorted(r[0] for r in after)
            if name != "toxicity":
                assert kept == brute_stages(name, before, sf_dir), name
                continue
            label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            gone = {r[0] for r in before} - set(kept)
            insulted = {r[0] for r in before if INSULTS & set(re.findall("[a-z]+", r[1].lower()))}
            assert insulted <= gone and sum(label.get(i) == 0 for i in gone) <= 0.01 * len(label)
            assert len(gone - insulted) <= 0.02 * len(before)
    assert docs.agg({"length": "sum"}).first()[0] > 0
