"""The pipeline against a brute-force version of each stage, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_dedup import brute_exact
from tests.llm.test_jaccard import brute_kept


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.exceptAll(before).count() == 0


def test_quality(spark, sf, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = after.join(labels, "doc_id")
    assert kept.where("toxic = 1").count() <= 0.2 * labels.where("toxic = 1").count() + 1
    assert kept.where("toxic = 0 and quality = 1").count() >= 0.9 * labels.where("toxic = 0 and quality = 1").count()


def test_copies(stages):
    _, before, after = stages[1]
    want = {d for d, _, _, kept in brute_exact([(r.doc_id, r.text) for r in before.collect()]) if kept}
    assert {r.doc_id for r in after.collect()} == want
    _, before, after = stages[2]
    assert sorted(r.doc_id for r in after.collect()) == brute_kept([(r.doc_id, r.text) for r in before.collect()])


def test_benchmark(spark, sf, stages):
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d for d, *_, bad in brute([(r.doc_id, r.text) for r in before.collect()], items) if not bad}
    assert {r.doc_id for r in after.collect()} == want


def test_packing(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_odd_documents(spark, sf, odd):
    """All stages, quality too, take null and repeated ids, odd texts and columns with clashing names; rows come out as they went in."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
            docs = spark.createDataFrame(odd.collect() if name == "quality" else out.collect(), docs.schema)  # odd texts are of poor quality, mostly
    assert out.where("piece = 0").count() == docs.count() > 0


def test_empty_table(spark, sf, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == nothing.columns)
