"""Registered queries against their SQL, and the pipeline stage by stage."""

import oracle
import pytest
from bioscore.llm import decontam, ngram_join, pii, queries, toxicity

import corpus_pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    assert not oracle.differences(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_queries_are_registered():
    import __spark_entry__ as driver
    names = set(driver.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each decision of a stage equals that of the operator on the stage's own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]

    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    model = queries.toxicity_model(spark, docs, sf_dir)
    assert ids(clean) == ids(toxicity.score(docs, model).where("not toxic"))

    single = stages["near_duplicates"](spark, clean, sf_dir).cache()
    assert ids(single) == ids(ngram_join.near_duplicates(clean).where("class_id = doc_id"))

    apart = stages["decontamination"](spark, single, sf_dir).cache()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(apart) == ids(decontam.contamination(single, bench).where("not contaminated"))

    private = stages["personal_data"](spark, apart, sf_dir).cache()
    assert private.columns == docs.columns and ids(private) == ids(apart)
    before = {r.doc_id: r.text for r in apart.collect()}
    for r in private.collect():
        real = {before[r.doc_id][a:b] for a, b, _, _ in pii.entities(before[r.doc_id])}
        assert not any(x in r.text for x in real) and r.n_chars == len(r.text)
        assert real or r.text == before[r.doc_id]

    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids(private)
