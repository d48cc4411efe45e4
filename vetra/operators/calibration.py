"""Temperature scaling of logits, all heads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.storage import dropped, stored

TOLERANCE, TURNS = 1e-12, 100


def temperatures(logits: DataFrame, head: str = "head", label: str = "label", logit: str = "logit") -> DataFrame:
    """(head, observed_count, status, temperature, loss_before, loss_after, turns): of each head, the temperature by which its logits have the least mean log loss.

    Rows are summed to (head, logit, label) once. The loss is convex in the logits' factor, 1 / temperature; a turn sums its slope and curvature for all heads in one
    aggregate, takes a Newton step where it stays between the factors known to be too small and too great, and halves the interval, or doubles the factor, where not. So it ends for
    any data, in some ten turns. status: OK; INSUFFICIENT_CLASSES (no temperature); NO_SIGNAL (the best factor is 0 or less); SEPARABLE (each logit is on its label's side, and the loss falls for ever). Rows
    without a label or logit are left out; labels other than 0 and 1, and logits that aren't finite, fail.
    """
    y, x = F.col(label).cast("double"), F.col(logit).cast("double")
    fine = F.when(y.isin(0.0, 1.0) & (F.abs(x) < float("inf")), x).otherwise(F.raise_error(F.lit("labels must be 0 or 1, and logits finite")).cast("double"))
    rows = stored(logits.where(F.col(label).isNotNull() & F.col(logit).isNotNull()).groupBy(F.col(head).alias("h"), fine.alias("x"), y.alias("y")).agg(F.count("*").cast("double").alias("n")), "logits")
    loss = lambda b: F.sum(F.col("n") * (F.greatest(b * F.col("x"), F.lit(0.0)) - b * F.col("x") * F.col("y") + F.log1p(F.exp(-F.abs(b * F.col("x")))))) / F.sum("n")
    chance = lambda b: 1 / (1 + F.exp(-b * F.col("x")))
    slope = lambda b: F.sum(F.col("n") * (chance(b) - F.col("y")) * F.col("x"))
    first = rows.groupBy("h").agg(F.sum("n").cast("long").alias("observed_count"), F.sum(F.col("n") * F.col("y")).alias("positive"), loss(F.lit(1.0)).alias("loss_before"), slope(F.lit(0.0)).alias("at_0"), F.min((2 * F.col("y") - 1) * F.col("x")).alias("worst"))
    status = F.when((F.col("positive") == 0) | (F.col("positive") == F.col("observed_count")), "INSUFFICIENT_CLASSES").when(F.col("at_0") >= 0, "NO_SIGNAL").when(F.col("worst") >= 0, "SEPARABLE")
    heads = stored(first.select("*", status.alias("status")), "heads")
    now = stored(heads.where("status is null").select("h", F.lit(1.0).alias("b"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).alias("turns"), F.lit(False).alias("done")), "factors")
    for _ in range(TURNS):
        if now.where("not done").isEmpty():
            break
        sums = rows.join(now.where("not done").select("h", "b"), "h").groupBy("h").agg(slope(F.col("b")).alias("g"), F.sum(F.col("n") * chance(F.col("b")) * (1 - chance(F.col("b"))) * F.col("x") * F.col("x")).alias("c"))
        both = now.join(sums, "h", "left").withColumns({"low": F.when(F.col("g") < 0, F.col("b")).otherwise(F.col("low")), "high": F.when(F.col("g") >= 0, F.col("b")).otherwise(F.col("high"))})
        step = F.col("b") - F.try_divide("g", "c")
        inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
        to = F.when(F.col("done"), F.col("b")).when(F.col("g") == 0, F.col("b")).when(inside, step).when(F.col("high") < float("inf"), (F.col("low") + F.col("high")) / 2).otherwise(2 * F.col("b"))
        moved = both.select("h", to.alias("to"), "b", "low", "high", F.when(F.col("done"), F.col("turns")).otherwise(F.col("turns") + 1).alias("turns"), "done")
        after = stored(moved.select("h", F.col("to").alias("b"), "low", "high", "turns", (F.col("done") | (F.abs(F.col("to") - F.col("b")) <= TOLERANCE * F.col("to"))).alias("done")), "factors")
        dropped(now)
        now = after
    found = rows.join(now.select("h", "b"), "h").groupBy("h", "b").agg(loss(F.col("b")).alias("loss_after"))
    out = heads.join(now.select("h", "turns"), "h", "left").join(found, "h", "left")
    status = F.coalesce("status", F.lit("OK"))
    return out.select(F.col("h").alias(head), "observed_count", status.alias("status"), F.when(status == "OK", 1 / F.col("b")).alias("temperature"), "loss_before", F.when(status == "OK", F.col("loss_after")).alias("loss_after"), F.coalesce("turns", F.lit(0)).alias("turns"))


def scaled(logits: DataFrame, found: DataFrame, head: str = "head", logit: str = "logit") -> DataFrame:
    """logits with score, the chance by the head's temperature; by 1 where it has none."""
    t = found.select(F.col(head).alias("_h"), F.coalesce("temperature", F.lit(1.0)).alias("_t"))
    return logits.join(t, F.col(head).eqNullSafe(F.col("_h")), "left").withColumn("score", 1 / (1 + F.exp(-F.col(logit) / F.coalesce("_t", F.lit(1.0))))).drop("_h", "_t")
