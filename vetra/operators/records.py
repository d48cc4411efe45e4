"""Inventories and manifests turned into records, roles, projections and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.operators.metrics import HEADS, wide

# Datasets whose audio is kept decoded; the reasons that a resumed inventory gives.
CACHED = ("aime-open-model-subset", "fma-small")
COPY, FINE, BROKEN = "EXCLUDE_REDUNDANT_EXACT_DUPLICATE_COPY", "GO_WAVEFAKE_CC_BY_SA_4_WITH_ATTRIBUTION_SA_AND_CHANGES_NOTICE", "EXCLUDE_TECHNICAL_AUDIT_FAILURE"


def cache_eligible(dataset: Column) -> Column:
    """Whether a record's audio is kept decoded; a null dataset's isn't."""
    return F.coalesce(dataset.isin(*CACHED), F.lit(False))


def renewed_roles(inventory: DataFrame, directory: str, generator: str, nested: str = "generated", member: str = "zip_member") -> DataFrame:
    """An inventory in which one directory's rows get role, generator, training_eligible and eligibility_reason anew, by where the member lies and how it was read; other rows stay.

    A member below a second folder of the nested name is a redundant copy and never eligible; another one is if it parsed and its checksum held.
    """
    here = F.coalesce(F.col("dataset_dir") == directory, F.lit(False))
    parts = F.split(F.replace(F.col(member), F.lit("\\"), F.lit("/")), "/")
    copy = F.coalesce((F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == nested), F.lit(False))
    fine = F.coalesce((F.col("parse_status") == "OK") & (F.col("crc_status") == "OK"), F.lit(False))
    new = {
        "role": F.when(copy, "redundant_duplicate_copy").otherwise("generated"), "generator": F.lit(generator), "training_eligible": ~copy & fine,
        "eligibility_reason": F.when(copy, COPY).when(fine, FINE).otherwise(BROKEN),
    }
    kinds = dict(inventory.dtypes)
    return inventory.withColumns({c: F.when(here, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()})


def records(heads: DataFrame) -> DataFrame:
    """A record for each row of a manifest whose heads are rows (see metrics.label_heads()): its text columns, duration_seconds as a number, and labels and masks as arrays in the order of the heads.

    An unknown label is 0 with a false mask. A duration that is no number fails.
    """
    keys = ["dataset", "sample_id", "source_family", "generator_or_provider", "content_group_key", "recommended_content_split", "source_locator", "codec", "sample_rate_hz", "channels", "duration_seconds"]
    own = wide(heads.withColumn("score", F.lit(0.0)), keys, label="head_label")
    number = F.coalesce(F.col("duration_seconds").try_cast("double"), F.raise_error(F.concat(F.lit("no duration: "), F.coalesce(F.col("duration_seconds").cast("string"), F.lit("null")))).cast("double"))
    labels = F.array(*[F.coalesce(F.col(f"{h}_label").cast("double"), F.lit(0.0)) for h in HEADS])
    return own.select(*keys[:-1], number.alias("duration_seconds"), labels.alias("labels"), F.array(*[F.col(f"{h}_mask") for h in HEADS]).alias("masks"))


def flattened(metrics: DataFrame, constants: dict[str, object], whole: DataFrame | None = None) -> DataFrame:
    """Metric rows behind columns of constants, and before those of a one-row table that all of them share."""
    out = metrics.select(*[F.lit(v).alias(k) for k, v in constants.items()], *metrics.columns)
    return out if whole is None else out.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one").drop("_one")


def interval_rows(intervals: DataFrame, constants: dict[str, object]) -> DataFrame:
    """A report row for each metric's interval: the constants, valid_replicates, metric, mean, lower, upper."""
    return intervals.select(*[F.lit(v).alias(k) for k, v in constants.items()], "valid_replicates", "metric", "mean", "lower", "upper")


def stable(seeds: DataFrame, values: list[str], most: float = 0.005) -> DataFrame:
    """(metric, seed_count, mean, deviation, passed) over seeds, nulls left out: whether the population deviation is `most` at most. Without a value it isn't."""
    long = seeds.unpivot([], values, "metric", "value")
    out = long.groupBy("metric").agg(F.count("value").alias("seed_count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return out.withColumn("passed", F.coalesce(F.col("deviation") <= most, F.lit(False)))


def projection(files: DataFrame, duration: str, segment_seconds: float, most_segments: int, samples: int, epochs: int, seeds: int, rate: float, safety: float, gate_hours: float) -> DataFrame:
    """One row: how long training would take, from the validation files' segments and a measured rate, and whether that is within the gate.

    A file has one segment at least and most_segments at most. Durations that are null count as one segment.
    """
    own = F.greatest(F.lit(1), F.least(F.lit(most_segments), F.coalesce(F.ceil(F.col(duration).cast("double") / segment_seconds), F.lit(1))))
    out = files.agg(F.coalesce(F.sum(own), F.lit(0)).alias("validation_segments_per_seed"))
    hours = (F.lit(samples * epochs) + F.col("validation_segments_per_seed")) / (rate * safety) / 3600
    out = out.select(F.lit(samples * epochs).cast("long").alias("training_samples_per_seed"), F.lit(samples * epochs * seeds).cast("long").alias("training_samples_all_seeds"), "validation_segments_per_seed", F.lit(rate * safety).alias("conservative_samples_per_second"), hours.alias("projected_hours_per_seed"), (hours * seeds).alias("projected_hours_all_seeds"))
    return out.withColumn("status", F.when(F.col("projected_hours_all_seeds") <= gate_hours, "READY_FOR_FULL_TRAINING").otherwise("BLOCKED_RESOURCE"))


def differing_fields(expected: DataFrame, found: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(field, expected, found) of two one-row tables where numbers differ by more than the tolerance, other values at all, or a field is missing: a report against its derivation, or a run's record against another."""
    side = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in df.columns])).alias("x")).select("x.*")
    x, y = F.col("expected").try_cast("double"), F.col("found").try_cast("double")
    out = side(expected, "expected").join(side(found, "found"), "field", "full")
    return out.where(~F.coalesce(F.abs(x - y) <= tolerance, F.col("expected").eqNullSafe(F.col("found"))))


def output_scope(listed: DataFrame, root: str, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """(path, issue) of files (path) below a root against what may be there: unexpected, forbidden (its name has one of the words), or missing."""
    at = F.regexp_replace("path", "^file:/+", "/")
    top = "/" + root.removeprefix("file:").strip("/") + "/"
    own = listed.where(at.startswith(top)).select(F.substring(at, len(top) + 1, 1 << 20).alias("path"))
    name = F.lower(F.substring_index("path", "/", -1))
    bad = reduce(lambda a, b: a | b, [name.contains(w.lower()) for w in forbidden], F.lit(False))
    issue = F.when(bad, "forbidden").when(~F.col("path").isin(*allowed), "unexpected")
    due = listed.sparkSession.createDataFrame([(x,) for x in allowed], "path string")
    return own.select("path", issue.alias("issue")).where("issue is not null").unionByName(due.join(own, "path", "left_anti").select("path", F.lit("missing").alias("issue")))


def manifest_audit(manifest: DataFrame, report: dict[str, int], split: str = "recommended_content_split", group: str = "content_group_key") -> DataFrame:
    """(metric, derived, reported, agrees): rows in all and by split, groups that cross splits, and rows of no known split, counted from the table alone and held against a report."""
    by = manifest.groupBy(group).agg(*[F.count_if(F.col(split) == s).alias(s) for s in ("train", "validation", "test")], F.count("*").alias("n"))
    kinds = sum((F.col(s).cast("boolean").cast("int") for s in ("train", "validation", "test")), F.lit(0))
    one = by.agg(F.sum("n").alias("row_count"), *[F.sum(s).alias(f"{s}_rows") for s in ("train", "validation", "test")], F.count_if(kinds > 1).alias("crossing_groups"), F.sum(F.col("n") - F.col("train") - F.col("validation") - F.col("test")).alias("other_rows"))
    long = one.unpivot([], one.columns, "metric", "derived").withColumn("derived", F.coalesce("derived", F.lit(0)))
    told = manifest.sparkSession.createDataFrame(list(report.items()), "metric string, reported long")
    return long.join(told, "metric", "left").withColumn("agrees", F.col("derived").eqNullSafe(F.col("reported")))


def one_by_one(run, table: DataFrame, key: str, keys: list, values: list[str], parts: int = 7) -> DataFrame:
    """One row: the keys tried, and the largest difference of run()'s values between a table of one key's rows alone and the whole one, whatever the order of its rows.

    run() is called once for each of the given keys, so give few.
    """
    whole = run(table.repartition(parts)).select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in values])
    alone = reduce(DataFrame.unionByName, [run(table.where(F.col(key).eqNullSafe(F.lit(k)))).select(key, *values) for k in keys])
    pairs = alone.join(whole, F.col(key).eqNullSafe(F.col("_k")), "left")
    same = reduce(lambda a, b: a & b, [F.col(v).isNull() == F.col(f"_{v}").isNull() for v in values])
    worst = F.greatest(*[F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    return pairs.agg(F.count_distinct(key).alias("key_count"), F.coalesce(F.max(worst), F.lit(0.0)).alias("max_absolute_delta"), F.coalesce(F.bool_and(same), F.lit(True)).alias("same_nulls"))
