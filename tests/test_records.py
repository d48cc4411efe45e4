"""Records, roles, projections and audits against hand values."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vetra.operators import metrics, records


def test_roles_of_one_directory_alone(spark):
    data = [("cv", "a/cv/generated/x.wav", "OK", "OK"), ("cv", "a\\cv\\generated\\x.wav", "OK", "OK"), ("cv", "a/cv/x.wav", "OK", "OK"), ("cv", "a/cv/x.wav", "ERROR", "OK"), ("cv", None, None, None), ("other", "a/b/generated/x.wav", "OK", "OK"), (None, "a/b/generated/x.wav", "OK", "OK")]
    df = spark.createDataFrame([(*x, "old", "old", "True", "old") for x in data], "dataset_dir string, zip_member string, parse_status string, crc_status string, role string, generator string, training_eligible string, eligibility_reason string")
    got = [(r.role, r.generator, r.training_eligible, r.eligibility_reason) for r in records.renewed_roles(df, "cv", "g").collect()]
    copy, fine, broken = ("redundant_duplicate_copy", "g", "false", records.COPY), ("generated", "g", "true", records.FINE), ("generated", "g", "false", records.BROKEN)
    assert got == [copy, copy, fine, broken, broken, ("old", "old", "True", "old"), ("old", "old", "True", "old")]


def test_records(spark):
    df = spark.createDataFrame([("fma-small", "real", "1", "8.5"), ("wavefake-1.2.0", "synthetic", "2", "1")], "dataset string, label string, sample_id string, duration_seconds string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("source_family", "generator_or_provider", "content_group_key", "recommended_content_split", "source_locator", "codec", "sample_rate_hz", "channels")])
    got = {r.sample_id: r for r in records.records(metrics.label_heads(df)).collect()}
    assert (got["1"].duration_seconds, got["1"].labels, got["1"].masks) == (8.5, [0, 0, 0, 0, 1], [True, False, True, False, True])
    assert (got["2"].labels, got["2"].masks) == ([1, 1, 0, 1, 0], [True, True, False, True, True])
    with pytest.raises(Exception, match="no duration"):
        records.records(metrics.label_heads(df.withColumn("duration_seconds", F.lit("long")))).collect()
    assert rows(df.select(records.cache_eligible(F.col("dataset")).alias("c"))) == [(False,), (True,)]


def test_stability_and_projection(spark):
    seeds = spark.createDataFrame([(0.9, 0.5, None), (0.905, 0.9, None), (0.91, 0.1, None)], "a double, b double, c double")
    got = {r.metric: r for r in records.stable(seeds, ["a", "b", "c"]).collect()}
    assert [got[k].passed for k in "abc"] == [True, False, False] and got["a"].deviation == pytest.approx(math.sqrt(2 / 3) * 0.005) and got["c"].seed_count == 0
    files = spark.createDataFrame([("0.5",), ("8",), ("8.1",), ("500",), (None,)], "seconds string")
    out = records.projection(files, "seconds", 8.0, 8, 100, 2, 3, 10.0, 0.8, 24.0)
    r = out.first()
    assert (r.validation_segments_per_seed, r.training_samples_all_seeds, r.status) == (1 + 1 + 2 + 8 + 1, 600, "READY_FOR_FULL_TRAINING")
    assert r.projected_hours_all_seeds == pytest.approx(3 * 213 / 8 / 3600)
    assert records.projection(files, "seconds", 8.0, 8, 100, 2, 3, 10.0, 0.8, 0.01).first().status == "BLOCKED_RESOURCE"
    assert records.differing_fields(out, out).count() == 0
    told = out.withColumn("status", F.lit("x")).withColumn("projected_hours_per_seed", F.col("projected_hours_per_seed") + 1e-13).drop("training_samples_per_seed").withColumn("more", F.lit(1))
    assert sorted(r.field for r in records.differing_fields(out, told).collect()) == ["more", "status", "training_samples_per_seed"]


def test_scope(spark):
    listed = spark.createDataFrame([("file:/r/a/run.json",), ("/r/a/best.checkpoint",), ("/r/a/x/other.txt",), ("/elsewhere/run.json",)], "path string")
    assert rows(records.output_scope(listed, "/r/a", ["run.json", "due.csv"], ["Checkpoint"])) == [("best.checkpoint", "forbidden"), ("due.csv", "missing"), ("x/other.txt", "unexpected")]


def test_manifest_audit(spark):
    df = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "validation"), ("h", "dev"), (None, None)], "content_group_key string, recommended_content_split string")
    got = {r.metric: (r.derived, r.agrees) for r in records.manifest_audit(df, {"row_count": 5, "test_rows": 2}).collect()}
    assert got == {"row_count": (5, True), "train_rows": (1, False), "validation_rows": (1, False), "test_rows": (1, False), "crossing_groups": (1, False), "other_rows": (2, False)}
    assert all(r.derived == 0 for r in records.manifest_audit(df.limit(0), {}).collect())


def test_one_by_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", None), (None, 3.0)], "k string, v double")
    fine = records.one_by_one(lambda t: t.groupBy("k").agg(F.avg("v").alias("v")), df, "k", ["a", "b", None], ["v"]).first()
    assert tuple(fine) == (2, 0.0, True)
    leaks = records.one_by_one(lambda t: t.crossJoin(t.agg(F.count("*").alias("n"))).groupBy("k").agg(F.max("n").cast("double").alias("v")), df, "k", ["a"], ["v"]).first()
    assert leaks.max_absolute_delta == 3.0
