"""Streams that are stopped, partial refreshes, lineage of plans, temperatures, the manifest's load."""

import math
import os
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from vetra.operators import calibration, checks
from vetra.operators import plan_lineage as pl
from vetra.plans import loading
from vetra.streaming import refreshed, runs


def test_a_stream_killed_between_write_and_commit(spark, tmp_path):
    """The first run dies after a batch is written and before it is committed; the second gives each file once, and the state says so."""
    source, sink, state, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "state", "checkpoint"))
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    commit, calls = runs.committed_once(sink, lambda df: df.withColumn("twice", F.col("id") * 2)), []

    def dies(batch, number):
        commit(batch, number)
        calls.append(number)
        if number == 1:
            raise RuntimeError("power cut")

    def run(**more):
        return runs.run_stream(spark, "id long", source, sink, checkpoint, state, "audit", files_at_once=2, **more)

    with pytest.raises(Exception, match="power cut"):
        runs.ended(run(commit=dies))
    first = runs.run_status(spark.read.parquet(state)).first()
    assert (first.run, first.status, first.starts) == ("audit", "FAILED", 1) and "power cut" in first.message
    assert spark.read.parquet(sink).count() == 40  # the second batch is there, though not committed
    runs.ended(run(commit=commit))
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(60))
    assert spark.read.parquet(sink).select("batch").distinct().count() == 3
    done = runs.run_status(spark.read.parquet(state)).first()
    assert (done.status, done.message, done.starts, done.batches, done.rows) == ("COMPLETE", None, 2, 3, 60)
    runs.ended(run(commit=commit))  # nothing new
    assert spark.read.parquet(sink).count() == 60 and runs.run_status(spark.read.parquet(state)).first().rows == 60


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, f"p{k % 4}" if k % 4 else None, "a" if k % 3 else None, k) for k in range(80)], "id int, part string, kind string, v int")
    df.write.partitionBy("part").parquet(path)
    times = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "t").rglob("*.parquet"))}
    new = spark.createDataFrame([(1, "b"), (5, "b"), (2, "a"), (999, "b")], "id int, kind string")  # 2 has this value already, 999 isn't there
    own = spark.read.parquet(path)
    counted = own.groupBy("part", "kind").agg(F.count("*").alias("n"))
    n, counts = refreshed.refresh_partitions(spark, path, "part", new, "id", ["kind"], {"by": (spark.createDataFrame(counted.collect(), counted.schema), ["part", "kind"])})
    assert n == 1
    spark.catalog.refreshByPath(path)
    after = spark.read.parquet(path)
    want = sorted((k, f"p{k % 4}" if k % 4 else None, "b" if k in (1, 5) else "a" if k % 3 else None, k) for k in range(80))
    assert sorted(map(tuple, after.select("id", "part", "kind", "v").collect())) == want
    left = {f: t for f, t in times.items() if os.path.exists(f)}
    assert all("part=p1" not in f for f in left) and len(left) == sum("part=p1" not in f for f in times)
    assert all(os.stat(f).st_mtime_ns == t for f, t in left.items())
    assert rows(counts["by"]) == rows(after.groupBy("part", "kind").agg(F.count("*").alias("n")))
    assert refreshed.refresh_partitions(spark, path, "part", new, "id", ["kind"])[0] == 0


def test_null_partitions_are_refreshed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None, "a"), (2, "x", "a")], "id int, part string, kind string").write.partitionBy("part").parquet(path)
    assert refreshed.refresh_partitions(spark, path, "part", spark.createDataFrame([(1, "b")], "id int, kind string"), "id", ["kind"])[0] == 1
    assert rows(spark.read.parquet(path).select("id", "kind", "part")) == [(1, "b", None), (2, "a", "x")]


def test_columns_by_their_use(spark):
    t = spark.createDataFrame([("g", "test", "y", 1.0, [1])], "grp string, split string, label string, score double, parts array<int>")
    u = spark.createDataFrame([("g", "z")], "k string, w string")
    of = pl.sources_of
    assert of(t.select("grp")) == {"grp": {"value"}}
    assert of(t.where("label = 'y'").select("grp")) == {"grp": {"value"}, "label": {"filter"}}  # a filter on a dropped column
    assert of(t.join(u, F.col("label") == F.col("k")).select("grp", "w")) == {"grp": {"value"}, "w": {"value"}, "label": {"join"}, "k": {"join"}}
    assert of(t.withColumn("x", F.upper("label")).drop("x").select("split")) == {"split": {"value"}}  # carried along and dropped
    assert of(t.withColumnRenamed("label", "z").select(F.concat("z", "grp").alias("c")).select(F.col("c").alias("d"))) == {"label": {"value"}, "grp": {"value"}}
    assert of(t.groupBy("grp").agg(F.max("score").alias("m"), F.max("label").alias("l")).select("m")) == {"grp": {"group"}, "score": {"value"}}
    assert of(t.select("grp", "score").unionByName(t.select(F.col("label").alias("grp"), "score")).select("grp")) == {"grp": {"value"}, "label": {"value"}}
    assert of(t.orderBy("label").limit(1).select("grp")) == {"grp": {"value"}, "label": {"order"}}
    ranked = t.select("grp", F.row_number().over(Window.partitionBy("split").orderBy("label")).alias("r"))
    assert of(ranked.select("grp")) == {"grp": {"value"}} and set(of(ranked)) == {"grp", "split", "label"} and "window" in of(ranked)["label"]
    assert of(t.select(F.explode("parts").alias("p"), "grp").select("grp")) == {"grp": {"value"}, "parts": {"generate"}}
    assert "distinct" in of(t.select("grp", "label").distinct().select("grp"))["label"]
    assert "distinct" in of(t.dropDuplicates(["label"]).select("grp"))["label"]
    assert "distinct" in of(t.select("grp").exceptAll(u.select("w")))["w"]
    assert "python" in of(t.select("label", "score").mapInArrow(lambda b: b, "a string, b double").select("b"))["label"]
    assert of(t.where("split = 'a'").alias("x").join(t.alias("y"), F.expr("x.grp = y.grp")).select("y.score")) == {"score": {"value"}, "grp": {"join"}, "split": {"filter"}}


def test_forbidden_columns_are_found(spark):
    t = spark.createDataFrame([("g", "test", "y")], "grp string, split string, label string")
    assert pl.must_not_read(t.select("grp", "split"), ["label"]).count() == 1
    with pytest.raises(ValueError, match="label.*filter"):
        pl.must_not_read(t.where("label <> 'n'").select("grp"), ["label"])
    with pytest.raises(ValueError, match="label.*join"):
        pl.must_not_read(t.alias("a").join(t.alias("b"), F.expr("a.label = b.label")).select("a.grp"), ["label"])
    assert pl.must_not_read(t.where("label <> 'n'").select("grp"), ["label"], uses=("value",)).count() == 1


def brute_temperature(data):
    """The factor with the least loss, by narrowing down from a grid."""
    loss = lambda b: sum(max(b * x, 0) - b * x * y + math.log1p(math.exp(-abs(b * x))) for x, y in data) / len(data)
    low, high = 1e-4, 1e4
    for _ in range(300):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return 1 / low, loss(1.0), loss(low)


def test_temperatures(spark):
    r = random.Random(4)
    data = {"sharp": [], "flat": [], "far": []}
    for head, scale in (("sharp", 6.0), ("flat", 0.2), ("far", 300.0)):
        for _ in range(400):
            x = r.gauss(0, 1.5)
            data[head].append((scale * x, float(r.random() < 1 / (1 + math.exp(-x)))))
    more = [("one", 0.5, 1.0), ("one", -0.5, 1.0), ("parted", 2.0, 1.0), ("parted", -1.0, 0.0), ("against", 1.0, 0.0), ("against", -1.0, 1.0), ("none", 1.0, None), ("one", None, 1.0)]
    df = spark.createDataFrame([(h, x, y) for h, own in data.items() for x, y in own] + more, "head string, logit double, label double").repartition(3)
    got = {r["head"]: r for r in calibration.temperatures(df).collect()}
    for h, own in data.items():
        t, before, after = brute_temperature(own)
        assert got[h].status == "OK" and got[h].temperature == pytest.approx(t, rel=1e-5) and got[h].loss_before == pytest.approx(before, rel=1e-9) and got[h].loss_after == pytest.approx(after, rel=1e-9)
        assert got[h].turns < 40
    assert {h: (got[h].status, got[h].temperature) for h in ("one", "parted", "against")} == {"one": ("INSUFFICIENT_CLASSES", None), "parted": ("SEPARABLE", None), "against": ("NO_SIGNAL", None)}
    assert "none" not in got
    score = {(x["head"], x.logit): x.score for x in calibration.scaled(df, calibration.temperatures(df)).where("logit is not null").collect()}
    x = data["sharp"][0][0]
    assert score["sharp", x] == pytest.approx(1 / (1 + math.exp(-x / got["sharp"].temperature))) and score["one", 0.5] == pytest.approx(1 / (1 + math.exp(-0.5)))
    with pytest.raises(Exception, match="finite"):
        calibration.temperatures(spark.createDataFrame([("a", float("nan"), 1.0)], df.select("head", "logit", "label").schema)).collect()


def manifest(spark, **change):
    base = {"dataset": "fma-small", "label": "real", "sample_id": "1", "content_group_key": "g1", "recommended_content_split": "train", "training_eligible": "True"}
    data = [base, base | {"sample_id": "2", "content_group_key": "g2", "recommended_content_split": "validation"}, base | {"sample_id": "3", "content_group_key": "g3", "recommended_content_split": "test", "label": "SENTINEL", "dataset": "SENTINEL"}, base | change]
    return spark.createDataFrame([tuple(x.values()) for x in data], ", ".join(f"{k} string" for k in base))


@pytest.mark.parametrize(("change", "rule"), [({"sample_id": "1"}, "unique"), ({"sample_id": "9", "training_eligible": "False"}, "condition:eligible"), ({"sample_id": "9", "content_group_key": ""}, "required:content_group_key"), ({"sample_id": "9", "recommended_content_split": "dev"}, "allowed:recommended_content_split")])
def test_loading_finds_faults(spark, change, rule):
    got = loading.load(manifest(spark, **change))
    assert [r.rule for r in got.faults.collect()] == [rule]


def test_loading(spark):
    """What held-out rows say beside group and split changes nothing; groups across splits are found."""
    got = loading.load(manifest(spark, sample_id="4", content_group_key="g3"))
    assert got.faults.count() == 0 and rows(got.crossings) == [("g3", "test|train")]
    assert got.train.count() == 10 and got.validation.count() == 5
    assert checks.isolated(lambda t: loading.load(t).train, manifest(spark, sample_id="4"), ["label", "dataset", "sample_id"], F.col("recommended_content_split") == "test").count() == 0
    with pytest.raises(Exception, match="label contract"):
        loading.load(manifest(spark, sample_id="4", label="synthetic")).train.collect()
    with pytest.raises(Exception, match="has no group"):
        loading.load(manifest(spark, sample_id="4", content_group_key="", recommended_content_split="test")).crossings.collect()
