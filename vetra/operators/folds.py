"""Metrics of held-out folds and of what is left without them, by subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetra.functions.numbers import ratio
from vetra.operators.metrics import by_score, running
from vetra.storage import stored


def _metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AUC and EER of each key from running counts of its own scores."""
    fpr, fnr = ratio(F.col("fp"), F.col("neg")), 1 - ratio(F.col("tp"), F.col("pos"))
    out = rows.groupBy(*keys).agg(
        F.sum(F.col("p") + F.col("n")).alias("observed"), F.sum("p").alias("positive"), ratio(F.sum(F.col("p") * (F.col("fb") + F.col("n") / 2)), F.max("pos") * F.max("neg")).alias("auc"), F.min_by((fpr + fnr) / 2, F.struct(F.abs(fpr - fnr), -F.col("s"))).alias("eer"),
    )
    fine = (F.col("positive") > 0) & (F.col("positive") < F.col("observed"))
    return out.withColumns({m: F.when(fine, F.col(m)) for m in ("auc", "eer")})


def leave_out(long: DataFrame, holdout: str, head: str = "head", label: str = "label", score: str = "score") -> DataFrame:
    """(fold, head): rows, positives, AUC and EER of each value of the hold-out column (held_*), and of all other rows without it (rest_*).

    A fold's rest is the whole less the fold. Its counts are differences. Its area is one too: positives and negatives of the whole and of the fold meet in four products, all of which
    the fold's own scores give. Its error rates cross once as the threshold falls, so they are sought in ranges of the scores: sums of a range less
    the fold's say in which range they cross, and only the scores of that range, of whole and fold, are looked at. So rows grow with ranges and
    folds, and with the rows of one range for each fold, not with rows and folds; no list of folds is read. Null hold-out values are part of every rest, and no fold.
    """
    rows = long.select(F.col(holdout).alias("fold"), F.col(head).alias("head"), F.col(label).alias("label"), F.col(score).alias("score"))
    own = stored(by_score(rows, ["fold"]), "fold-scores")
    every = stored(running(own.groupBy("head", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [], "range"), "fold-whole")
    folds = own.where("fold is not null")
    held = _metrics(running(folds, ["fold"]), ["fold", "head"])

    # each of the fold's scores with the whole's counts there
    met = stored(folds.alias("f").join(every.alias("w"), ["head", "s"]).select("f.fold", "head", "s", "f.p", "f.n", F.col("w.fb").alias("below"), F.col("w.n").alias("whole_n"), F.col("w.tp").alias("above"), F.col("w.p").alias("whole_p"), "range"), "fold-met")
    counted = running(met, ["fold"])
    total = F.struct("pos", "neg")
    whole = every.groupBy("head").agg(F.first(total).alias("t"), F.sum(F.col("p") * (F.col("fb") + F.col("n") / 2)).alias("area")).select("head", "t.*", "area")
    fold = counted.groupBy("fold", "head").agg(
        F.sum("p").alias("fold_pos"), F.sum("n").alias("fold_neg"),
        F.sum(F.col("p") * (F.col("below") + F.col("whole_n") / 2)).alias("fold_p_whole_n"),
        F.sum(F.col("n") * (F.col("above") - F.col("whole_p") / 2)).alias("whole_p_fold_n"),
        F.sum(F.col("p") * (F.col("fb") + F.col("n") / 2)).alias("fold_area"),
    )
    pairs = F.col("rest_pos") * F.col("rest_neg")
    rest = fold.join(whole, "head").withColumns({"rest_pos": F.col("pos") - F.col("fold_pos"), "rest_neg": F.col("neg") - F.col("fold_neg")})
    rest = rest.withColumn("rest_auc", F.when(pairs > 0, (F.col("area") - F.col("fold_p_whole_n") - F.col("whole_p_fold_n") + F.col("fold_area")) / pairs))

    # the range in which a rest's rates cross: the first whose end has FPR >= FNR
    ends = every.groupBy("head", "range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    mine = met.groupBy("fold", "head", "range").agg(F.sum("p").alias("fp_"), F.sum("n").alias("fn_"))
    grid = rest.select("fold", "head", "rest_pos", "rest_neg").where(F.expr("rest_pos > 0 and rest_neg > 0")).join(ends, "head").join(mine, ["fold", "head", "range"], "left")
    down = Window.partitionBy("fold", "head").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    left = lambda a, b: F.col(a) - F.coalesce(b, F.lit(0))
    grid = grid.withColumns({"p": left("p", "fp_"), "n": left("n", "fn_")}).withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    crossed = F.col("fp") / F.col("rest_neg") >= 1 - F.col("tp") / F.col("rest_pos")
    at = stored(grid.where(crossed).groupBy("fold", "head").agg(F.min(F.struct("range", (F.col("tp") - F.col("p")).alias("tp0"), (F.col("fp") - F.col("n")).alias("fp0"), "rest_pos", "rest_neg")).alias("x")).select("fold", "head", "x.*"), "fold-ranges")
    before = stored(grid.where("p + n > 0").join(at.select("fold", "head", F.col("range").alias("to")), ["fold", "head"]).where("range < to").groupBy("fold", "head").agg(F.max("range").alias("range")), "fold-before")

    # the scores of that range, and the last score before it
    near = lambda df: df.join(every.select("head", "range", "s", F.col("p").alias("wp"), F.col("n").alias("wn")), ["head", "range"]).join(met.select("fold", "head", "s", "p", "n"), ["fold", "head", "s"], "left").select("*", left("wp", "p").alias("rp"), left("wn", "n").alias("rn")).where("rp + rn > 0")
    falling = Window.partitionBy("fold", "head").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    inside = near(at).select("fold", "head", "s", "rest_pos", "rest_neg", (F.col("tp0") + F.sum("rp").over(falling)).alias("tp"), (F.col("fp0") + F.sum("rn").over(falling)).alias("fp"))
    last = near(before).groupBy("fold", "head").agg(F.min("s").alias("s")).join(at, ["fold", "head"]).select("fold", "head", "s", "rest_pos", "rest_neg", F.col("tp0").alias("tp"), F.col("fp0").alias("fp"))
    fpr, fnr = F.col("fp") / F.col("rest_neg"), 1 - F.col("tp") / F.col("rest_pos")
    eer = inside.unionByName(last).groupBy("fold", "head").agg(F.min_by((fpr + fnr) / 2, F.struct(F.abs(fpr - fnr), -F.col("s"))).alias("rest_eer"))
    out = held.select("fold", "head", F.col("observed").cast("long").alias("held_count"), F.col("positive").cast("long").alias("held_positive"), F.col("auc").alias("held_auc"), F.col("eer").alias("held_eer"))
    out = out.join(rest.select("fold", "head", (F.col("rest_pos") + F.col("rest_neg")).cast("long").alias("rest_count"), F.col("rest_pos").cast("long").alias("rest_positive"), "rest_auc"), ["fold", "head"])
    return out.join(eer, ["fold", "head"], "left")


def worst_fold(folds: DataFrame) -> DataFrame:
    """Of each head: folds with both classes, the macro EER over them, the worst one and its fold (ties: the first), for what is held out and for the rest."""
    return folds.groupBy("head").agg(
        F.count("held_eer").alias("fold_count"), F.avg("held_eer").alias("held_macro_eer"), F.max("held_eer").alias("held_worst_eer"), F.min_by("fold", F.when(F.col("held_eer").isNotNull(), F.struct(-F.col("held_eer"), "fold"))).alias("held_worst_fold"),
        F.avg("rest_eer").alias("rest_macro_eer"), F.max("rest_eer").alias("rest_worst_eer"),
    )
