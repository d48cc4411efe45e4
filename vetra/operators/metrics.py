"""Classification metrics over long tables (row, head, label, score), where a null label is unknown.

All come from one aggregate of rows by (keys, head, score), so ties are one row, and a weight per row (as of a bootstrap
replicate) is a matter of sums. Running counts over falling scores go by ranges of equal size (see ordinals.running_sums), so no task sorts a
whole head, however its scores crowd.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.functions.numbers import ratio
from vetra.operators.ordinals import running_sums

# Heads in order, their weights, and which of them count by 1 - EER; the others count by AUC.
HEADS = ("FILE_FAKE", "VOICE_FAKE", "MUSIC_FAKE", "VOICE_PRESENT", "MUSIC_PRESENT")
WEIGHTS = (0.45, 0.18, 0.27, 0.05, 0.05)
BY_ERROR_RATE = HEADS[:3]
# Labels of the heads by dataset, with the dataset's own label.
LABELS = {
    "ljspeech-1.1": ("real", (0, 0, None, 1, 0)),
    "wavefake-1.2.0": ("synthetic", (1, 1, None, 1, 0)),
    "fma-small": ("real", (0, None, 0, None, 1)),
    "aime-open-model-subset": ("synthetic", (1, None, 1, 0, 1)),
}
CLIP = 1e-12


def _with(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to b by the keys, of which nulls equal nulls; the keys are a's."""
    names = [f"_b{k}" for k in range(len(keys))]
    other = b.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in b.columns if c not in keys])
    return a.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], how).drop(*names)


def label_heads(df: DataFrame, dataset: str = "dataset", label: str = "label") -> DataFrame:
    """A row for each row and head, with head_label (null: unknown) by the dataset's contract; another label or dataset fails."""
    own = F.create_map(*[x for d, (_, v) in LABELS.items() for x in (F.lit(d), F.array(*[F.lit(y).cast("double") for y in v]))])
    expected = F.create_map(*[F.lit(x) for d, (n, _) in LABELS.items() for x in (d, n)])
    said = F.try_element_at(expected, F.col(dataset))
    broken = F.raise_error(F.concat(F.lit("label contract broken for "), F.coalesce(dataset, F.lit("null")), F.lit("/"), F.coalesce(label, F.lit("null")))).cast("array<double>")
    values = F.when(said == F.col(label), F.try_element_at(own, F.col(dataset))).otherwise(broken)
    return df.select("*", F.explode(F.arrays_zip(F.array(*map(F.lit, HEADS)).alias("head"), values.alias("head_label"))).alias("_h")).select(*df.columns, F.col("_h.head").alias("head"), F.col("_h.head_label").alias("head_label"))


def mask_summary(long: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows, known labels, masked ones and the distinct known values, by dataset and head."""
    values = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("head_label").cast("int"))), lambda v: v.cast("string")), ";")
    return long.groupBy(dataset, "head").agg(F.count("*").alias("row_count"), F.count("head_label").alias("observed_count"), (F.count("*") - F.count("head_label")).alias("masked_count"), values.alias("observed_values"))


def by_score(long: DataFrame, keys: list[str], head: str = "head", label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """Positive and negative weight of each score. Labels other than 0, 1, null, and scores that are null, NaN or outside [0, 1] fail."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    checked = F.when(y.isin(0.0, 1.0) & s.between(0, 1) & ~F.isnan(s), s).otherwise(F.raise_error(F.lit("labels must be 0 or 1, and scores in [0, 1]")).cast("double"))
    rows = long.where(F.col(label).isNotNull()).select(*keys, F.col(head).alias("head"), (checked + F.lit(0.0)).alias("s"), (w * y).alias("p"), (w * (1 - y)).alias("n"))
    return rows.groupBy(*keys, "head", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p + n > 0")


def running(scores: DataFrame, keys: list[str], ranges: str | None = None) -> DataFrame:
    """With tp and fp, the weights at this score or above; fb, the negative weight below; and the totals pos and neg. Scores go in ranges of equal size, however they crowd."""
    out = running_sums(scores, [F.desc("s")], {"tp": "p", "fp": "n"}, [*keys, "head"], {"pos": "p", "neg": "n"}, ranges)
    return out.withColumn("fb", F.col("neg") - F.col("fp"))


def _bin(s: Column, bins: int) -> Column:
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0.0, 1.0, bins + 1)])
    return F.least(F.size(F.filter(edges, lambda e: e <= s)) - 1, F.lit(bins - 1))


def head_metrics(long: DataFrame, keys: list[str] | None = None, head: str = "head", label: str = "label", score: str = "score", weight: str | None = None, bins: int = 15, heads: tuple[str, ...] | None = None) -> DataFrame:
    """Of each (keys, head): observed_count, positive_count, status, auc, eer, brier, log_loss, ece, component.

    status is OK with both classes, else INSUFFICIENT_CLASSES and all metrics are null. The EER is that of the first threshold,
    from the highest, with the least |FPR - FNR|. All heads of a key that has rows have one, or the given heads; without any known
    label its counts are 0.
    """
    keys = keys or []
    own = [*keys, "head"]
    rows = running(by_score(long, keys, head, label, score, weight), keys)
    fpr, fnr = ratio(F.col("fp"), F.col("neg")), 1 - ratio(F.col("tp"), F.col("pos"))
    clipped = F.least(F.greatest(F.col("s"), F.lit(CLIP)), F.lit(1 - CLIP))
    total = F.sum(F.col("p") + F.col("n"))
    out = rows.groupBy(*own).agg(
        total.alias("observed_count"),
        F.sum("p").alias("positive_count"),
        ratio(F.sum(F.col("p") * (F.col("fb") + F.col("n") / 2)), F.max("pos") * F.max("neg")).alias("auc"),
        F.min_by((fpr + fnr) / 2, F.struct(F.abs(fpr - fnr), -F.col("s"))).alias("eer"),
        (F.sum(F.col("p") * F.pow(F.col("s") - 1, 2) + F.col("n") * F.pow(F.col("s"), 2)) / total).alias("brier"),
        (-F.sum(F.col("p") * F.ln(clipped) + F.col("n") * F.ln(1 - clipped)) / total).alias("log_loss"),
    )
    cells = rows.groupBy(*own, _bin(F.col("s"), bins).alias("bin")).agg(F.sum(F.col("p") + F.col("n")).alias("w"), F.sum((F.col("p") + F.col("n")) * F.col("s")).alias("ws"), F.sum("p").alias("wp"))
    ece = cells.groupBy(*own).agg((F.sum(F.abs(F.col("ws") - F.col("wp"))) / F.sum("w")).alias("ece"))
    out = _with(out, ece, own)
    if heads is None:
        whole = long.select(*keys, F.col(head).alias("head")).distinct()
    else:
        base = long.select(*keys).distinct() if keys else long.sparkSession.range(1)
        whole = base.select(*keys, F.explode(F.array(*map(F.lit, heads))).alias("head"))
    out = _with(whole, out, own, "left").fillna(0, ["observed_count", "positive_count"])
    fine = (F.col("positive_count") > 0) & (F.col("positive_count") < F.col("observed_count"))
    out = out.withColumns({m: F.when(fine, F.col(m)) for m in ("auc", "eer", "brier", "log_loss", "ece")})
    component = F.when(F.col("head").isin(*BY_ERROR_RATE), 1 - F.col("eer")).otherwise(F.col("auc"))
    return out.select(*own, F.col("observed_count").cast("long").alias("observed_count"), F.col("positive_count").cast("long").alias("positive_count"), F.when(fine, "OK").otherwise("INSUFFICIENT_CLASSES").alias("status"), "auc", "eer", "brier", "log_loss", "ece", component.alias("component"))


def composite(metrics: DataFrame, keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """ADS, CPS and the weighted score of each key from its five heads' components. A missing component fails if strict, else it makes the row null."""
    keys = keys or []
    one = lambda h: F.max(F.when(F.col("head") == h, F.col("component")))
    out = metrics.groupBy(*keys).agg(*[one(h).alias(h) for h in HEADS])
    if strict:
        out = out.withColumns({h: F.coalesce(h, F.raise_error(F.lit(f"no component of {h}")).cast("double")) for h in HEADS})
    a, b, c, d, e = map(F.col, HEADS)
    out = out.withColumns({"ads": 0.5 * a + 0.2 * b + 0.3 * c, "cps": 0.5 * d + 0.5 * e})
    return out.withColumn("score", 0.9 * F.col("ads") + 0.1 * F.col("cps")).select(*keys, *HEADS, "ads", "cps", "score")


def unpivot_axes(long: DataFrame, axes: list[str]) -> DataFrame:
    """A row for each row and axis, with axis and slice (as text)."""
    rest = [c for c in long.columns if c not in axes]
    return long.select(*rest, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("slice")) for a in axes])).alias("_x")).select(*rest, "_x.axis", "_x.slice")


def slice_metrics(long: DataFrame, axes: list[str], heads: tuple[str, ...] = HEADS, weights: tuple[float, ...] = WEIGHTS, **columns: str) -> DataFrame:
    """head_metrics() of each axis and slice, null slices too: a row for each head, with its weight."""
    w = F.create_map(*[F.lit(x) for kv in zip(heads, weights, strict=True) for x in kv])
    return head_metrics(unpivot_axes(long, axes), ["axis", "slice"], heads=heads, **columns).withColumn("head_weight", F.try_element_at(w, F.col("head")))


def slice_completeness(reported: DataFrame, long: DataFrame, axes: list[str], heads: tuple[str, ...] = HEADS) -> DataFrame:
    """(axis, slice, head, issue) of a slice report against the rows: missing, unexpected, or repeated rows."""
    key = ["axis", "slice", "head"]
    due = unpivot_axes(long, axes).select("axis", "slice").distinct().select("axis", "slice", F.explode(F.array(*map(F.lit, heads))).alias("head"))
    sides = due.withColumns({"due": F.lit(1), "told": F.lit(0)}).unionByName(reported.select(*key).withColumns({"due": F.lit(0), "told": F.lit(1)}))
    n = sides.groupBy(*key).agg(F.sum("due").alias("due"), F.sum("told").alias("told"))
    issue = F.when(F.col("due") == 0, "unexpected").when(F.col("told") == 0, "missing").when(F.col("told") > 1, "repeated")
    return n.select(*key, issue.alias("issue")).where("issue is not null")


def slice_labels(long: DataFrame, axes: list[str], head: str = "head", label: str = "label", first: str = HEADS[0], heads: tuple[str, ...] = HEADS) -> DataFrame:
    """Of each slice: rows, rate of the first head, whether it is pure (risk HIGH, else MONITOR), and each head's known labels and rate."""
    out = unpivot_axes(long, axes).groupBy("axis", "slice").agg(
        F.count_if(F.col(head) == first).alias("row_count"),
        F.avg(F.when(F.col(head) == first, F.col(label))).alias("first_rate"),
        *[x for h in heads for x in (F.count(F.when(F.col(head) == h, F.col(label))).alias(f"{h}_observed_count"), F.avg(F.when(F.col(head) == h, F.col(label))).alias(f"{h}_positive_rate"))],
    )
    pure = F.coalesce(F.col("first_rate").isin(0.0, 1.0), F.lit(False))
    return out.withColumns({"label_pure": pure, "shortcut_risk": F.when(pure, "HIGH").otherwise("MONITOR")})


def seed_summary(metrics: DataFrame, values: list[str], head: str = "head") -> DataFrame:
    """Mean, population deviation, least and greatest of each metric over seeds, nulls left out."""
    long = metrics.unpivot([head], values, "metric", "value")
    return long.groupBy(head, "metric").agg(F.count("value").alias("seed_count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def balanced_loss(logits: DataFrame, head: str = "head", label: str = "label", logit: str = "logit", weights: dict[str, float] | None = None) -> DataFrame:
    """One row: the weighted sum over heads of the mean of each class's mean cross-entropy with logits; a head without known labels adds 0."""
    weights = weights or dict(zip(HEADS, WEIGHTS, strict=True))
    x, y = F.col(logit), F.col(label)
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    by_class = logits.where(y.isNotNull()).groupBy(head, label).agg(F.avg(loss).alias("loss")).groupBy(head).agg(F.avg("loss").alias("loss"))
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return by_class.agg(F.coalesce(F.sum(F.col("loss") * F.try_element_at(w, F.col(head))), F.lit(0.0)).alias("loss"))


def recall_at(long: DataFrame, threshold: float, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Recall of each class, their mean (balanced accuracy) and the false negative rate at a fixed threshold."""
    hit = F.col(score) >= threshold
    rate = lambda c, h: F.avg(F.when(F.col(label) == c, h.cast("double")))
    out = long.where(F.col(label).isNotNull()).groupBy(*keys).agg(rate(1, hit).alias("recall_1"), rate(0, ~hit).alias("recall_0"))
    return out.withColumns({"balanced_accuracy": (F.col("recall_1") + F.col("recall_0")) / 2, "false_negative_rate": 1 - F.col("recall_1")})


def file_probability(voice_present: Column, voice_fake: Column, music_present: Column, music_fake: Column) -> Column:
    return 1 - (1 - voice_present * voice_fake) * (1 - music_present * music_fake)


def wide(long: DataFrame, keys: list[str], head: str = "head", label: str = "label", score: str = "score") -> DataFrame:
    """A row for each key with HEAD_label, HEAD_mask and HEAD_prediction of each head."""
    pick = lambda h, c: F.max(F.when(F.col(head) == h, F.col(c)))
    return long.groupBy(*keys).agg(*[x for h in HEADS for x in (pick(h, label).alias(f"{h}_label"), pick(h, label).isNotNull().alias(f"{h}_mask"), pick(h, score).alias(f"{h}_prediction"))])


def order_invariance(run, table: DataFrame, keys: list[str], values: list[str], parts: int = 7) -> DataFrame:
    """One row: rows, and the largest difference of run()'s values between the table and the same rows dealt otherwise."""
    a, b = run(table), run(table.repartition(parts))
    pairs = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    worst = F.greatest(*[F.coalesce(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    return pairs.agg(F.count("*").alias("row_count"), F.coalesce(F.max(worst), F.lit(0.0)).alias("max_absolute_delta"))
