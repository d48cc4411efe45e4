"""Deterministic sampling and the bootstrap over groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.functions.hashing import unit
from vetra.operators.metrics import HEADS, composite, head_metrics
from vetra.operators.ordinals import numbered
from vetra.storage import stored

#: Groups that exact draws are made for on the driver, at most.
EXACT_GROUPS = 100_000
#: Upper ends of the Poisson(1) counts 0, 1, 2, ...
POISSON = tuple(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist())


def evenly_spaced(df: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """Of each group, `count` rows at even places in the order (the middle one for 1), rounded half to even. A smaller group fails."""
    rows = numbered(df, order, group, "_at", 0, "_n")
    size = F.when(F.col("_n") >= count, F.col("_n")).otherwise(F.raise_error(F.lit("a group has too few rows")).cast("long"))
    places = F.array(F.floor(size / 2)) if count == 1 else F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (size - 1) / (count - 1)).cast("long"))
    return rows.where(F.array_contains(places, F.col("_at").cast("long"))).withColumnRenamed("_at", "position").drop("_n")


def every_nth(df: DataFrame, order: list[Column], group: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each group in the order."""
    return numbered(df, order, group, "position", 0).where(F.col("position") % n == 0)


def best(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row by a full order, ties spelt out by the caller."""
    return df.orderBy(*order).limit(1)


def poisson_weights(keys: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight): each key's Poisson(1) count in each replicate, by a hash; rows of weight 0 are left out.

    Drawn for each key alone, so it needs no list of keys, and holds at any size.
    """
    u = unit(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")))
    rows = keys.select(key).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return rows.withColumn("weight", F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda e: e <= u))).where("weight > 0")


def exact_weights(keys: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight) from numpy's default generator over the sorted keys, drawn on the driver; for EXACT_GROUPS keys at most."""
    own = [r[0] for r in keys.select(key).distinct().orderBy(key).limit(EXACT_GROUPS + 1).collect()]
    if len(own) > EXACT_GROUPS:
        raise ValueError(f"more than {EXACT_GROUPS} groups: use poisson_weights")
    g = np.random.default_rng(seed)
    rows = [(k, own[i], int(n)) for k in range(replicates) for i, n in enumerate(np.bincount(g.integers(0, len(own), size=len(own)), minlength=len(own))) if n]
    return keys.sparkSession.createDataFrame(rows, f"replicate int, {key} {dict(keys.dtypes)[key]}, weight int")


def group_bootstrap(long: DataFrame, group: str, weights: DataFrame, heads: tuple[str, ...] = HEADS) -> DataFrame:
    """Composite and components of each replicate in which all heads have both classes. long: head, label, score and the group.

    Equal scores of a group are summed before they meet the replicates, so a replicate has a row for a group's score, not for each row.
    """
    packed = long.where("label is not null").groupBy(group, "head", "label", "score").agg(F.count("*").alias("_n"))
    rows = packed.join(weights, group).withColumn("_w", F.col("_n") * F.col("weight"))
    metrics = head_metrics(rows, ["replicate"], weight="_w")
    return composite(metrics, ["replicate"], strict=False).where("score is not null") if heads == HEADS else metrics


def intervals(replicates: DataFrame, values: list[str], confidence: float = 0.95) -> DataFrame:
    """Of each metric: valid replicates, mean and the percentile interval; none at all fails."""
    low = (1 - confidence) / 2
    long = replicates.unpivot([], values, "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("valid_replicates"), F.avg("value").alias("mean"), F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(1 - low)).alias("upper"))


def fixture_scores(rows: int, seed: int) -> np.ndarray:
    """Label-independent scores (rows, heads) for tests of the evaluation."""
    return np.random.default_rng(seed).uniform(0.025, 0.975, size=(rows, len(HEADS)))


def strata_summary(df: DataFrame, stratum: str, group: str) -> DataFrame:
    return df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count_distinct(group).alias("group_count"), F.count("*").alias("row_count"), F.lit(0.25).alias("target_fraction"))


def balanced_sample(df: DataFrame, stratum: str, group: str, record: str, draws: int, seed: int, epoch: int = 0) -> DataFrame:
    """(stratum, draw, group, record): of each stratum `draws` records with replacement, group first, by hashes.

    Groups are numbered within their stratum by ranges, and so are the records of drawn groups, which alone are shuffled; neither a stratum's groups nor a group's records are one row or one task.
    """
    u = lambda *parts: unit(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    base = df.where(F.col(stratum).isNotNull() & F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(stratum).alias("stratum"), F.col(group).cast("string").alias("grp"), F.col(record).cast("string").alias("rec"))
    groups = numbered(base.select("stratum", "grp").distinct(), [F.col("grp")], ["stratum"], "at", 0, "size")
    drawn = groups.select("stratum", "size").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = F.floor(u(seed, epoch, F.col("stratum"), F.col("draw").cast("string")) * F.col("size"))
    picks = stored(drawn.select("stratum", "draw", at.alias("at")).join(groups.drop("size"), ["stratum", "at"]).select("stratum", "draw", "grp"), "drawn-groups")
    members = numbered(base.join(picks.select("stratum", "grp").distinct(), ["stratum", "grp"], "left_semi"), [F.col("rec")], ["stratum", "grp"], "at", 0, "size")
    sizes = members.select("stratum", "grp", "size").distinct()
    at = F.floor(u(seed, epoch, F.col("stratum"), F.col("draw").cast("string"), "record") * F.col("size"))
    chosen = picks.join(sizes, ["stratum", "grp"]).select("stratum", "grp", "draw", at.alias("at"))
    return chosen.join(members.drop("size"), ["stratum", "grp", "at"]).select("stratum", "draw", F.col("grp").alias("group"), F.col("rec").alias("record"))
