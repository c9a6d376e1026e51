import corpus_pipeline
import pytest
from conftest import SF

from quarry.llm import decontamination, near_duplicates, secret_scan, toxicity


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns_and_their_decisions_hold(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            assert set(after) == {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert set(after) == {r.doc_id for r in near_duplicates.link(docs).where("kept").collect()}
        elif name == "decontamination":
            assert set(after) == set(before) - {r.doc_id for r in decontamination.matches(docs, bench).collect()}
        else:
            found = {r.doc_id for r in secret_scan.scan(docs).where("spans is not null").collect()}
            assert set(after) == set(before) and {i for i in after if after[i] != before[i]} == found
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
    assert {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.ids_crc32) for r in last.collect()}
