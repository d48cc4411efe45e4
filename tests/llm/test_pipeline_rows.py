"""Each row of the pipeline gets its own decision, whatever ids are null or repeat."""

import collections

import corpus_pipeline
from vetra.llm import quality

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string"


def left(stage, spark, rows, sf):
    return collections.Counter(tuple(r) for r in STAGES[stage](spark, spark.createDataFrame(rows, DOCS).repartition(3), sf).collect())


def test_exact_copies(spark, sf):
    """Only equal texts go: all of the odd documents by hand."""
    rows = [(None, "a", "x"), (None, "b", "x"), (None, "b", "w"), (None, None, "x"), (7, "", "x"), (8, "c", "x"), (8, "c", "x"), (9, "c", "x"), (14, "tie", "x"), (14, "another text", "x"), (9, "a", "x"), (9, "a", "x")]
    want = [(None, "b", "w"), (7, "", "x"), (9, "c", "x"), (14, "tie", "x"), (14, "another text", "x"), (9, "a", "x")]
    assert left("exact_dedup", spark, rows, sf) == collections.Counter(want)


def test_benchmark(spark, sf):
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    rows = [(d, t, "x") for d in (None, 3) for t in (item, "entirely other words", "and one more")]
    assert left("decontaminate", spark, rows, sf) == collections.Counter(r for r in rows if r[1] != item)


def test_quality(spark, sf, monkeypatch):
    """Rows of one id, or without any, that differ in their grade."""
    model = quality.fit(spark.createDataFrame([(k, "nasty words here" if k % 2 else "fine words here", "x") for k in range(200)], DOCS), spark.createDataFrame([(k, 0 if k % 2 else 2) for k in range(200)], "doc_id long, grade int"))
    monkeypatch.setattr(corpus_pipeline, "fit", lambda *_: model)
    rows = [(d, t, "x") for d in (None, 3) for t in ("fine words here", "nasty words here")]
    assert left("quality", spark, rows, sf) == collections.Counter(r for r in rows if "fine" in r[1])


def test_odd_documents_are_whole(spark, sf, odd):
    """All distinct texts of the odd documents but near copies are packed, both texts of id 14 and the one without an id among them."""
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = spark.createDataFrame((made := stage(spark, docs, sf)).collect(), made.schema)
    got = collections.Counter(r.doc_id for r in docs.where("piece = 0").collect())
    # 5 to 7 are near copies; 2 and 3 have no words
    assert got[14] == 2 and got[None] == 1 and got[8] == 1 and got[11] == 1 and got[10] == 0
    assert set(got) - {2, 3} == {4, 6, 8, None, 9, 11, 12, 13, 14} and len({2, 3} & set(got)) <= 1


def test_columns_survive(spark, sf):
    """Columns with the names that stages use, one of maps and one of structs among them, go through all stages unchanged, repeated rows too."""
    from pyspark.sql import functions as F

    names = ["_id", "_sha", "_place", "_word", "_bits", "_what", "_row", "row", "sha", "a", "b", "n", "_at"]
    texts = ["one two three four five six seven", "ONE two three four five six seven", "entirely other words here", "entirely other words here", "more", None]
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(None, "more"), (None, "more"), (2, "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat(F.lit("mine"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in names])
    docs = docs.withColumn("meta", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("nested", F.struct("doc_id", F.lit(1).alias("_id")))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    at = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns and out.schema["meta"].dataType == docs.schema["meta"].dataType
        at = spark.createDataFrame(out.collect(), docs.schema)
        for r in at.collect():
            assert all(r[n] == f"mine{'?' if r.doc_id is None else r.doc_id}" for n in names) and r.meta == {"k": r.doc_id} and r.nested.doc_id == r.doc_id
    assert collections.Counter((r.doc_id, r.text) for r in at.collect()) == collections.Counter([(0, texts[0]), (1, texts[2]), (2, "more"), (2, None)])
    assert STAGES["quality"](spark, docs, sf).columns == docs.columns
    assert STAGES["packing"](spark, docs, sf).count() == docs.count()
