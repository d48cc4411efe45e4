"""Named queries of records, roles, projections and audits, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vetra.operators import metrics, records
from vetra.operators.metrics import label_heads
from vetra.plans.queries import _LONG, _METRICS, ORACLES, _heads, _metric_columns, metrics_sql, training_manifest, unit_sql
from vetra.plans.registry import query, rounded, table
from vetra.sources import files
from vetra.storage import shared_dir


@query("""
WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'common' ELSE 'other' END AS dataset_dir, CASE doc_id % 4 WHEN 0 THEN 'a/common/generated/' || doc_id || '.wav' ELSE 'a/common/' || doc_id || '.wav' END AS zip_member, n_chars > 500 AS fine FROM documents)
SELECT doc_id, CASE WHEN dataset_dir <> 'common' THEN 'old' WHEN doc_id % 4 = 0 THEN 'redundant_duplicate_copy' ELSE 'generated' END AS role, CASE WHEN dataset_dir <> 'common' THEN 'old' ELSE 'conformer' END AS generator,
  CASE WHEN dataset_dir <> 'common' THEN true ELSE doc_id % 4 <> 0 AND fine END AS training_eligible,
  CASE WHEN dataset_dir <> 'common' THEN 'old' WHEN doc_id % 4 = 0 THEN 'EXCLUDE_REDUNDANT_EXACT_DUPLICATE_COPY' WHEN fine THEN 'GO_WAVEFAKE_CC_BY_SA_4_WITH_ATTRIBUTION_SA_AND_CHANGES_NOTICE' ELSE 'EXCLUDE_TECHNICAL_AUDIT_FAILURE' END AS eligibility_reason FROM x""")
def renewed_roles(spark, d):
    i = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "common").otherwise("other").alias("dataset_dir"), F.concat(F.when(F.col("doc_id") % 4 == 0, "a/common/generated/").otherwise("a\\common\\"), i, F.lit(".wav")).alias("zip_member"),
        F.when(F.col("n_chars") > 500, "OK").otherwise("ERROR").alias("parse_status"), F.lit("OK").alias("crc_status"), *[F.lit("old").alias(c) for c in ("role", "generator", "eligibility_reason")], F.lit(True).alias("training_eligible"),
    )
    return records.renewed_roles(docs, "common", "conformer").select("doc_id", "role", "generator", "training_eligible", "eligibility_reason")


@query(f"""SELECT dataset, sample_id, duration_seconds::DOUBLE AS duration_seconds, CASE dataset WHEN 'ljspeech-1.1' THEN '0;0;0;1;0' WHEN 'wavefake-1.2.0' THEN '1;1;0;1;0' WHEN 'fma-small' THEN '0;0;0;0;1' ELSE '1;0;1;0;1' END AS labels,
  CASE dataset WHEN 'ljspeech-1.1' THEN '1;1;0;1;1' WHEN 'wavefake-1.2.0' THEN '1;1;0;1;1' WHEN 'fma-small' THEN '1;0;1;0;1' ELSE '1;0;1;1;1' END AS masks, dataset IN ('fma-small', 'aime-open-model-subset') AS cached FROM ({ORACLES["training_manifest"]})""")
def manifest_records(spark, d):
    """The manifest as records, with labels and masks in the order of the heads, and whether their audio is kept decoded."""
    out = records.records(label_heads(training_manifest(spark, d)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ";")
    return out.select("dataset", "sample_id", "duration_seconds", text("labels").alias("labels"), text("masks").alias("masks"), records.cache_eligible(F.col("dataset")).alias("cached"))


@query(f"""WITH {_LONG}, {metrics_sql('')}, cc AS (SELECT 0.5 * max(component) FILTER (head = 'FILE_FAKE') + 0.2 * max(component) FILTER (head = 'VOICE_FAKE') + 0.3 * max(component) FILTER (head = 'MUSIC_FAKE') AS ads,
  0.5 * max(component) FILTER (head = 'VOICE_PRESENT') + 0.5 * max(component) FILTER (head = 'MUSIC_PRESENT') AS cps FROM m)
SELECT 7 AS seed, 'fixture' AS prediction_kind, head, observed_count, positive_count, status, {_metric_columns()}, round(ads, 9) AS ads, round(cps, 9) AS cps, round(0.9 * ads + 0.1 * cps, 9) AS score FROM m, cc""")
def flattened_metrics(spark, d):
    """Each head's metrics with the run's constants and the composite."""
    own = metrics.head_metrics(_heads(spark, d))
    whole = metrics.composite(own).select("ads", "cps", "score")
    return rounded(records.flattened(own, {"seed": 7, "prediction_kind": "fixture"}, whole), *_METRICS, "ads", "cps", "score", digits=9)


@query("""WITH v AS (SELECT sum(greatest(1, least(8, ceil(l_quantity / 8)))) AS n FROM lineitem)
SELECT 655360::BIGINT AS training_samples_per_seed, 1966080::BIGINT AS training_samples_all_seeds, n::BIGINT AS validation_segments_per_seed, 78.928::DOUBLE AS conservative_samples_per_second, round((655360 + n) / 78.928 / 3600, 9) AS projected_hours_per_seed, round((655360 + n) / 78.928 / 3600 * 3, 9) AS projected_hours_all_seeds,
  CASE WHEN (655360 + n) / 78.928 / 3600 * 3 <= 24 THEN 'READY_FOR_FULL_TRAINING' ELSE 'BLOCKED_RESOURCE' END AS status FROM v""")
def runtime_projection(spark, d):
    """How long training would take if lines were the validation files."""
    out = records.projection(table(spark, d, "lineitem"), "l_quantity", 8.0, 8, 32_768, 20, 3, 98.66, 0.8, 24.0)
    return rounded(out, "conservative_samples_per_second", "projected_hours_per_seed", "projected_hours_all_seeds", digits=9)


@query(f"""WITH m AS ({ORACLES["training_manifest"]}), x AS (SELECT count(*) AS row_count, count(*) FILTER (recommended_content_split = 'train') AS train_rows, count(*) FILTER (recommended_content_split = 'validation') AS validation_rows, count(*) FILTER (recommended_content_split = 'test') AS test_rows,
  (SELECT count(*) FROM (SELECT content_group_key FROM m GROUP BY 1 HAVING count(DISTINCT recommended_content_split) > 1)) AS crossing_groups, 0::BIGINT AS other_rows FROM m)
SELECT metric, derived, CASE metric WHEN 'crossing_groups' THEN 0 WHEN 'row_count' THEN -1 END::BIGINT AS reported, CASE metric WHEN 'crossing_groups' THEN derived = 0 WHEN 'row_count' THEN false ELSE false END AS agrees FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE derived)""")
def manifest_audit(spark, d):
    """The manifest counted again, against a report that is right about the crossings and wrong about the rows."""
    return records.manifest_audit(training_manifest(spark, d), {"crossing_groups": 0, "row_count": -1})


@query(f"""WITH {_LONG}, s AS (SELECT seed, avg((s - label) * (s - label)) AS brier, avg(s) AS score FROM (SELECT seed, label, {unit_sql("seed || '|' || head || '|' || doc_id")} AS s FROM long, (VALUES ('a'), ('b'), ('c')) v(seed)) WHERE label IS NOT NULL GROUP BY seed)
SELECT metric, count(v) AS seed_count, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS deviation, stddev_pop(v) <= 0.005 AS passed FROM (UNPIVOT s ON brier, score INTO NAME metric VALUE v) GROUP BY metric""")
def seed_stability(spark, d):
    """Whether two metrics vary by 0.005 at most over three seeds."""
    from vetra.functions.hashing import unit

    long = _heads(spark, d).where("label is not null").withColumn("seed", F.explode(F.array(*map(F.lit, "abc"))))
    own = long.withColumn("s", unit(F.concat_ws("|", "seed", "head", F.col("doc_id").cast("string"))))
    seeds = own.groupBy("seed").agg(F.avg(F.pow(F.col("s") - F.col("label"), 2)).alias("brier"), F.avg("s").alias("score"))
    return rounded(records.stable(seeds, ["brier", "score"]), "mean", "deviation", digits=9)


@query("SELECT 'a/' || r_regionkey || '.txt' AS path, CASE WHEN r_regionkey = 4 THEN 'forbidden' ELSE 'unexpected' END AS issue FROM (SELECT 1 AS r_regionkey UNION ALL SELECT 4) WHERE (SELECT count(*) FROM region) > 0 UNION ALL SELECT 'a/9.txt', 'missing'".replace("'a/' || r_regionkey || '.txt'", "CASE r_regionkey WHEN 4 THEN 'lang=MIDDLE EAST/checkpoint' ELSE 'lang=AMERICA/more' END"))
def output_scope(spark, d):
    """A folder with a file for each region, of which one isn't expected, one has a forbidden name, and one that is due isn't there."""
    top = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    table(spark, d, "region").select("r_name", F.col("r_name").alias("lang")).write.partitionBy("lang").parquet(top)
    names = {"AMERICA": "more", "MIDDLE EAST": "checkpoint"}
    listed = files.listing(spark, top, "*.parquet").withColumn("region", F.url_decode(F.regexp_extract("path", "lang=([^/]+)/", 1)))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("region"))
    named = listed.select(F.concat(F.lit(f"{top}/lang="), "region", F.lit("/"), F.coalesce(kind, F.lit("part"))).alias("path"))
    allowed = [f"lang={r}/part" for r in ("AFRICA", "ASIA", "EUROPE")] + ["a/9.txt"]
    return records.output_scope(named, top, allowed, ["checkpoint"])


@query("SELECT 4 AS key_count, 0.0::DOUBLE AS max_absolute_delta, true AS same_nulls FROM (SELECT count(*) AS n FROM documents) WHERE n > 0")
def one_by_one(spark, d):
    """Each language's metrics from its rows alone and from all rows."""
    long = _heads(spark, d).where("head = 'FILE_FAKE'")
    run = lambda t: metrics.head_metrics(t, ["lang"]).select("lang", "auc", "eer", "brier")
    out = records.one_by_one(run, long, "lang", ["en", "de", "fr", "es"], ["auc", "eer", "brier"])
    return out.select(F.col("key_count").cast("int").alias("key_count"), F.when(F.col("max_absolute_delta") < 1e-12, 0.0).otherwise(F.col("max_absolute_delta")).alias("max_absolute_delta"), "same_nulls")
